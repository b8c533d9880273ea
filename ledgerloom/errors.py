"""Errors with codes, and did-you-mean hints. Codes are fixed values; those of limits, budgets,
bindings, snapshots and configurations are this package's own."""

from __future__ import annotations

import difflib


class FormulaError(Exception):
    code = "ENGINE.UNKNOWN"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class FormulaSyntaxError(FormulaError):
    code = "ENGINE.SYNTAX_ERROR"


class SecurityError(FormulaError):
    code = "ENGINE.SECURITY_VIOLATION"


class UnknownFunctionError(FormulaError):
    code = "ENGINE.UNKNOWN_FUNCTION"


class UnknownVariableError(FormulaError):
    code = "ENGINE.MISSING_REQUIRED_INPUT"


class ArgumentError(FormulaError):
    code = "ENGINE.INVALID_ARGUMENT_COUNT"


class TypeMismatchError(FormulaError):
    code = "ENGINE.TYPE_MISMATCH"


class CircularReferenceError(FormulaError):
    code = "ENGINE.CIRCULAR_DEPENDENCY"


class LimitError(FormulaError):
    code = "ENGINE.LIMIT_EXCEEDED"


class BudgetError(LimitError):
    code = "ENGINE.OPERATION_BUDGET"


class BindingError(FormulaError):
    code = "ENGINE.BAD_BINDING"


class StaleContextError(FormulaError):
    code = "ENGINE.STALE_CONTEXT"


class SnapshotError(FormulaError):
    code = "ENGINE.SNAPSHOT_ERROR"


class ConfigError(FormulaError):
    code = "ENGINE.BAD_CONFIG"


def did_you_mean(name: str, known) -> str:
    near = difflib.get_close_matches(name.lower(), [k.lower() for k in known], n=1, cutoff=0.6)
    return f"; did you mean {next(k for k in known if k.lower() == near[0])!r}?" if near else ""

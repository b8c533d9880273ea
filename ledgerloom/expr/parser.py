"""Parses formulas with Python's ast module and checks them against a whitelist. Nothing is ever
evaluated by Python."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from ledgerloom.errors import FormulaError, FormulaSyntaxError, LimitError, SecurityError, UnknownFunctionError, UnknownVariableError, did_you_mean
from ledgerloom.expr.normalize import normalize

_NODES = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Constant, ast.Attribute, ast.Subscript, ast.Slice,
    ast.List, ast.Tuple, ast.Dict, ast.ListComp, ast.GeneratorExp, ast.comprehension, ast.JoinedStr, ast.FormattedValue, ast.Load, ast.Store, ast.keyword,
    ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Starred,
)
#: Functions that may hold a generator, methods that may be called.
GENERATOR_CALLS = frozenset({"sum", "min", "max", "any", "all", "sorted", "list", "tuple", "sumif", "countif", "filter_array", "count_unique", "average", "count"})
METHODS = frozenset({"get", "keys", "values", "items", "to_dict"})
_RESERVED = {"eval", "exec", "compile", "open", "globals", "locals", "vars", "getattr", "setattr", "delattr", "input", "breakpoint"}


@dataclass
class ValidationResult:
    valid: bool
    error: str | None = None
    code: str | None = None
    warnings: list[str] = field(default_factory=list)
    names: frozenset[str] = frozenset()
    functions: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Policy:
    """What a formula may hold. Filters are stricter than formulas."""

    subscripts: bool = True
    methods: bool = True
    max_subscript_depth: int | None = None
    max_iterable_size: int | None = None


FORMULA = Policy()
FILTER = Policy(subscripts=False, methods=False)


def parse(text: str, functions: dict[str, str] | None = None, policy: Policy = FORMULA) -> ast.expr:
    """The expression of a formula. functions: lower-case to registered names; None: not checked."""
    source = normalize(text, functions)
    if not source:
        raise FormulaSyntaxError("empty formula")
    try:
        tree = ast.parse(source, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaSyntaxError(f"{getattr(e, 'msg', e)} in {text!r}") from None
    _check(tree, set(functions.values()) if functions is not None else None, policy)
    return tree.body


def _check(tree: ast.AST, known: set[str] | None, policy: Policy) -> None:
    allowed_generators: set[int] = set()
    for node in ast.walk(tree):
        if not isinstance(node, _NODES):
            raise SecurityError(f"{type(node).__name__} is not allowed in a formula")
        if isinstance(node, ast.Name) and (node.id.startswith("__") or node.id in _RESERVED):
            raise SecurityError(f"name {node.id!r} is not allowed")
        if isinstance(node, ast.Attribute) and node.attr.startswith("_"):
            raise SecurityError(f"attribute {node.attr!r} is not allowed")
        if isinstance(node, ast.Subscript):
            depth, at = 1, node.value
            while isinstance(at, ast.Subscript):
                depth, at = depth + 1, at.value
            if not policy.subscripts:
                raise SecurityError("subscripts are not allowed here")
            if policy.max_subscript_depth and depth > policy.max_subscript_depth:
                raise LimitError(f"subscripts are nested {depth} deep")
        if isinstance(node, (ast.List, ast.Tuple)) and policy.max_iterable_size and len(node.elts) > policy.max_iterable_size:
            raise LimitError(f"a list of {len(node.elts)} elements")
        if isinstance(node, (ast.ListComp, ast.GeneratorExp)) and (len(node.generators) != 1 or node.generators[0].is_async):
            raise SecurityError("comprehensions have one `for`")
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute):
                if not policy.methods or node.func.attr not in METHODS:
                    raise SecurityError(f"method {node.func.attr!r} is not allowed")
            elif isinstance(node.func, ast.Name):
                name = node.func.id
                if known is not None and name not in known:
                    raise UnknownFunctionError(f"unknown function {name!r}{did_you_mean(name, known)}")
                if name in GENERATOR_CALLS:
                    allowed_generators |= {id(a) for a in node.args if isinstance(a, ast.GeneratorExp)}
            else:
                raise SecurityError("only named functions can be called")
    for node in ast.walk(tree):
        if isinstance(node, ast.GeneratorExp) and id(node) not in allowed_generators:
            raise SecurityError("a generator is only allowed directly inside an aggregate")


def names(tree: ast.expr) -> set[str]:
    """Variables that a formula reads: names that are neither functions nor bound by a comprehension."""
    found: set[str] = set()

    def walk(node: ast.AST, bound: frozenset[str]) -> None:
        if isinstance(node, ast.Name):
            if node.id not in bound:
                found.add(node.id)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            for part in [*node.args, *[k.value for k in node.keywords]]:
                walk(part, bound)
        elif isinstance(node, (ast.ListComp, ast.GeneratorExp)):
            loop = node.generators[0]
            walk(loop.iter, bound)
            inner = bound | {n.id for n in ast.walk(loop.target) if isinstance(n, ast.Name)}
            for part in (node.elt, *loop.ifs):
                walk(part, inner)
        else:
            for child in ast.iter_child_nodes(node):
                walk(child, bound)

    walk(tree, frozenset())
    return found - {"True", "False", "None"}


def called(tree: ast.expr) -> set[str]:
    return {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}


def validate(text: str, functions: dict[str, str], known=None, policy: Policy = FORMULA) -> ValidationResult:
    """Checks without compiling; known: variables that exist, if they are to be checked."""
    try:
        tree = parse(text, functions, policy)
        read = names(tree)
        if known is not None:
            for name in sorted(read - set(known)):
                raise UnknownVariableError(f"unknown variable {name!r}{did_you_mean(name, known)}")
    except FormulaError as e:
        return ValidationResult(False, str(e), e.code)
    warnings = [] if read else ["the formula is constant"]
    return ValidationResult(True, None, None, warnings, frozenset(read), frozenset(called(tree)))

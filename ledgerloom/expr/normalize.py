"""Cleans formula text and rewrites spreadsheet spellings to the expression grammar."""

from __future__ import annotations

import html
import re

_SPACES = "               　"
_TABLE = {ord(c): " " for c in _SPACES} | {ord(c): None for c in "​‌‍⁠﻿"}
_TABLE |= {ord(c): '"' for c in "“”„‟«»"} | {ord(c): "'" for c in "‘’‚‛"}
_OVERSIZE = re.compile(r"&#(?:x0*[0-9a-fA-F]{7,}|0*\d{8,});?")
_STRING = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")
_PERCENT = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?)%")
_SINGLE_EQUALS = re.compile(r"(?<![<>=!:])=(?!=)")
_DOLLAR = re.compile(r"\$(?!snap\b)(?=[A-Za-z_])")
_STAR = re.compile(r"\b([A-Za-z_]\w*)\.\*\.([A-Za-z_]\w*)")
_CALL = re.compile(r"\b([A-Za-z_]\w*)(\s*\()")
#: and( or( not( at the start of an operand are functions; elsewhere they are operators.
_LOGIC = {"and": "and_", "or": "or_", "not": "not_"}


def clean(text: str) -> str:
    """HTML entities, odd spaces and quotes, zero-width characters. Clean text stays as it is."""
    if "&" in text:
        text = html.unescape(_OVERSIZE.sub("", text))
    return text.translate(_TABLE)


def normalize(text: str, functions: dict[str, str] | None = None) -> str:
    """Formula text in the grammar that parser.parse() reads.

    functions: lower-case names to registered names, for calls in any case.
    """
    text = clean(str(text)).strip()
    if text.startswith("=") and not text.startswith("=="):
        text = text[1:].lstrip()
    pieces = _STRING.split(text)
    before = ""
    for k in range(0, len(pieces), 2):
        pieces[k] = _outside(pieces[k], functions or {}, before)
        before += pieces[k] + (pieces[k + 1] if k + 1 < len(pieces) else "")
    return "".join(pieces)


def _outside(part: str, functions: dict[str, str], before: str) -> str:
    part = _DOLLAR.sub("", part).replace("$snap", "snap")
    part = _PERCENT.sub(r"(\1/100)", part)
    part = part.replace("<>", "!=")
    part = _SINGLE_EQUALS.sub("==", part)
    part = _STAR.sub(r"map_key(\1, '\2')", part)

    def call(m: re.Match) -> str:
        low = m[1].lower()
        if low in _LOGIC:
            left = (before + part[: m.start()]).rstrip()
            operand = left == "" or left[-1] in "(,[:+-*/%<>=" or re.search(r"\b(and|or|not|if|else|in)$", left)
            return (_LOGIC[low] if operand else low) + m[2]
        return functions.get(low, m[1]) + m[2]

    part = _CALL.sub(call, part)
    return re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[0].lower(), part)

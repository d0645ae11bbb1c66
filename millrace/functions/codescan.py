"""Selecting the target function of a generated C text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column

from millrace.functions.arrow import arrow_function

# Words that look like calls but are not.
KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "catch"}

_IGNORED = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#(?:\\\n|[^\n])*",
    re.S | re.M,
)
_NAME_BEFORE_PAREN = re.compile(r"([A-Za-z_]\w*)\s*\(")
# Possessive, so that prose without a semicolon is read once.
_DECLARATION = re.compile(r"(?:^|(?<=[;{}(]))\s*+([A-Za-z_]\w*+(?:[\s*]++[A-Za-z_]\w*+)++([^;(){}]*+);)")
_NUMBER_SET = re.compile(r"=\s*[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]*\s*(?:,|$)")
_BRACKET = re.compile(r"[(){}]")
_BLANK = re.compile(r"[^\n]")
_RETURN = re.compile(r"(?:return|goto|typedef)\b")

RESULT = "text string, renamed boolean, candidates int"


def _closings(code: str) -> dict[int, int]:
    """Place after the closing bracket of every opening one that has it; parentheses and braces apart."""
    ends, open_ = {}, {")": [], "}": []}
    for mark in _BRACKET.finditer(code):
        bracket = mark.group()
        if bracket in "({":
            open_[")" if bracket == "(" else "}"].append(mark.start())
        elif open_[bracket]:
            ends[open_[bracket].pop()] = mark.end()
    return ends


def _definitions(code: str):
    """(start, name start, name end, end) of each function body found, in order."""
    found, position, ends = [], 0, _closings(code)
    while match := _NAME_BEFORE_PAREN.search(code, position):
        position = match.end()
        if match.group(1) in KEYWORDS:
            continue
        after = ends.get(match.end() - 1)
        if after is None:
            continue
        opening = re.compile(r"\s*\{").match(code, after)
        if not opening:
            continue
        end = ends.get(opening.end() - 1)
        if end is None:
            continue
        before = max(code.rfind(mark, 0, match.start()) for mark in ";{}") + 1
        start = before + len(code[before : match.start()]) - len(code[before : match.start()].lstrip())
        found.append((start, match.start(1), match.end(1), end))
        position = end
    return found


def select_function(text: str, name: str, pick: str):
    """The chosen function renamed, after the declarations of the text that set a number."""
    code = _IGNORED.sub(lambda m: _BLANK.sub(" ", m.group()), text)
    out = [
        text[m.start(1) : m.end(1)]
        for m in _DECLARATION.finditer(code)
        if _NUMBER_SET.search(m.group(2)) and not _RETURN.match(m.group(1))
    ]
    definitions = _definitions(code)
    own = {d[1] for d in definitions}
    called = {m.group(1) for m in _NAME_BEFORE_PAREN.finditer(code) if m.start(1) not in own}
    free = [d for d in definitions if code[d[1] : d[2]] not in called]
    candidates = free or definitions
    renamed = False
    if candidates:
        longest = pick == "longest"
        chosen = max(candidates, key=lambda d: d[3] - d[0]) if longest else candidates[-1]
        start, name_start, name_end, end = chosen
        renamed = name_start > start
        new_name = name if renamed else text[name_start:name_end]
        out.append(text[start:name_start] + new_name + text[name_end:end])
    return {"text": "\n".join(out), "renamed": renamed, "candidates": len(candidates)}


def target_function(text: str | Column, name: str | Column, pick: str = "last") -> Column:
    """Struct of the target function's text, whether it was renamed, and its rivals.

    A definition nothing else in the text calls or declares is preferred. Among
    several the last is taken, or with ``pick="longest"`` the longest. A
    definition without a return type has no room for the rename and is kept as
    it is, with ``renamed`` false.
    """
    if pick not in ("last", "longest"):
        raise ValueError("pick is 'last' or 'longest'")
    type_ = pa.struct([("text", pa.string()), ("renamed", pa.bool_()), ("candidates", pa.int32())])

    def scan(texts: pa.Array, names: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), names.to_pylist())
        return pa.array([None if t is None else select_function(t, n, pick) for t, n in rows], type_)

    return arrow_function(scan, RESULT)(text, name)

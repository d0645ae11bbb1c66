"""Cleaning of generated text, as Column expressions.

Fences are found with string positions rather than a pattern over ``(.|\\n)*``,
which recurses per character in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped from text ends, fence mark, call pattern,
# calling conventions.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FENCE = "```"
CALL_LIKE = r"[a-zA-Z0-9_]{2,} *\("
SPACED_CONVENTIONS = (" __fastcall ", " __cdecl ")
BARE_CONVENTIONS = ("__fastcall", "__cdecl", "__usercall")


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    Lambdas inside ``body`` must not mention its argument: Spark does not run a
    Python function over such an expression.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: str | Column) -> Column:
    return F.btrim(_col(text), F.lit(WHITESPACE))


def fenced_code(text: str | Column, greedy: bool = False) -> Column:
    """Stripped content of the first code fence, or the stripped text without one.

    The content starts on the line after the opening fence and ends at the next
    fence, or with ``greedy`` at the last.
    """
    text = _col(text)

    def content(body: Column) -> Column:
        """``body`` starts after the opening line; null where there is none."""
        if greedy:
            end = F.length(body) - F.length(F.substring_index(body, FENCE, -1)) - 3
        else:
            end = F.locate(FENCE, body) - 1
        return F.when(F.contains(body, F.lit(FENCE)), body.substr(F.lit(1), end)).otherwise(text)

    def after(text: Column, mark: str) -> Column:
        """The text after the first ``mark``, null without it."""
        at = F.locate(mark, text)
        return F.when(at > 0, text.substr(at + len(mark), F.length(text)))

    # Each part is bound before use, or it would be cut anew for every mention.
    tail = after(text, FENCE)
    return strip(bind(bind(tail, lambda tail: after(tail, "\n")), content))


def without_fence_marks(text: str | Column) -> Column:
    """Delete the fence marks and keep everything else."""
    return F.replace(F.replace(_col(text), F.lit("```c"), F.lit("")), F.lit(FENCE), F.lit(""))


def without_conventions(text: str | Column, spaced: bool = False) -> Column:
    """Remove calling conventions; ``spaced`` replaces them and their spaces by one."""
    out = _col(text)
    for word in SPACED_CONVENTIONS if spaced else BARE_CONVENTIONS:
        out = F.replace(out, F.lit(word), F.lit(" " if spaced else ""))
    return out


def _pieces(calls: int | None) -> int:
    """Limit of a split at the first ``calls`` matches, or at all of them."""
    return -1 if calls is None else calls + 1


def rename_first_function(
    text: str | Column, source: str | Column, name: str = "func0", calls: int | None = None
) -> Column:
    """Rename the call-like names on the first line that has one.

    Include lines before it that the source already has are blanked. The names
    on the line, or the first ``calls`` of them, each become ``" name("``.
    """
    source = _col(source)

    def repeated_include(line: Column) -> Column:
        return F.contains(line, F.lit("#include")) & F.contains(source, line)

    def renamed(line: Column) -> Column:
        return F.array_join(F.split(line, CALL_LIKE, _pieces(calls)), f" {name}(")

    def has_calls(line: Column) -> Column:
        return ~repeated_include(line) & line.rlike(CALL_LIKE)

    def blanked(line: Column) -> Column:
        return F.when(repeated_include(line), F.lit("")).otherwise(line)

    def aimed(lines: Column) -> Column:
        target = F.array_position(F.transform(lines, has_calls), True).cast("int")
        return F.struct(lines.alias("lines"), target.alias("target"), F.size(lines).alias("size"))

    def rewritten(found: Column) -> Column:
        lines, target, size = found["lines"], found["target"], found["size"]
        before = F.when(target == 0, size).otherwise(target - 1)
        hit = F.transform(F.slice(lines, before + 1, F.least(target, F.lit(1))), renamed)
        after = F.slice(lines, before + 2, size)
        return F.array_join(F.concat(F.transform(F.slice(lines, 1, before), blanked), hit, after), "\n")

    return bind(bind(F.split(_col(text), "\n"), aimed), rewritten)


def rename_conflicts(dependencies: str | Column, text: str | Column) -> Column:
    """Point calls at ``X__bench`` for every ``X__bench(...) {`` the dependencies define."""
    defined = F.regexp_extract_all(_col(dependencies), F.lit(r"(?U)(?<!\w)(\w+)__bench *\([^\n]*?\) *\{"), F.lit(1))
    return F.aggregate(
        defined,
        _col(text),
        lambda acc, item: F.regexp_replace(
            acc,
            F.concat(F.lit("(?<![a-zA-Z0-9_])"), item, F.lit(r"(?![a-zA-Z0-9_]) *\(")),
            F.concat(item, F.lit("__bench(")),
        ),
    )


def repoint_include(wrapper: str | Column, path: str, calls: int | None = None) -> Column:
    """Make a C wrapper's ``extern "C"`` blocks, or the first ``calls`` of them, include ``path``."""
    included = r'(?<=extern "C" \n\{\n#include ")[^\n]*?(?="\n\})'
    return F.array_join(F.split(_col(wrapper), included, _pieces(calls)), path)


def optimized_code(answer: str | Column) -> Column:
    """Fenced C code of the "optimized code" section, empty without one."""
    section = F.regexp_extract(_col(answer), r"(?i)# optimized code *\n([^#]*)#", 1)
    return F.regexp_extract(section, r"(?i)```c\n([\s\S]*)```", 1)


def apply_optimized(answer: str | Column, text: str | Column) -> Column:
    """The optimised code of ``answer``, or ``text`` where there is none."""
    code = optimized_code(answer)
    return F.when((F.length(code) > 0) & ~F.contains(code, F.lit("none")), code).otherwise(_col(text))


def _include_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit("#include")))


def hoist_includes(function: str | Column, test: str | Column) -> tuple[Column, Column]:
    """Include lines of function then test, and the test without its own.

    The includes come as one text, each line ended by a newline.
    """
    function, test = _col(function), _col(test)
    in_test = _include_lines(test)
    lines = F.concat(_include_lines(function), in_test)
    header = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    rest = F.aggregate(in_test, test, lambda acc, line: F.replace(acc, line, F.lit("")))
    return header, rest


def combined_program(
    function: str | Column, test: str | Column, generated: str | Column
) -> tuple[Column, Column]:
    """The program to run (includes, generated text, test), and it without the test."""
    header, rest = hoist_includes(function, test)
    bare = F.concat(header, F.lit("\n"), _col(generated))
    return F.concat(bare, F.lit("\n"), rest), bare


def with_dependencies(dependencies: str | Column, function: str | Column) -> Column:
    return F.concat(_col(dependencies), F.lit("\n"), _col(function))


def lines_mentioning(text: str | Column, name: str | Column) -> Column:
    """Lines of ``text`` that contain ``name``, with their line ends."""
    name = _col(name)

    def kept(lines: Column) -> Column:
        size = F.size(lines)
        ended = F.transform(F.slice(lines, 1, size - 1), lambda line: F.concat(line, F.lit("\n")))
        whole = F.concat(ended, F.slice(lines, size, 1))
        return F.array_join(F.filter(whole, lambda line: F.contains(line, name)), "")

    return bind(F.split(_col(text), "\n"), kept)


def first_nonempty(*texts: str | Column) -> Column:
    """The first text that is neither null nor empty; null if all are."""
    return F.coalesce(*[F.nullif(_col(text), F.lit("")) for text in texts])


def composite_id(*parts: str | Column) -> Column:
    return F.concat_ws("_", *[_col(part).cast("string") for part in parts])


def digits_of(name: str | Column) -> Column:
    """All digits of a file name, joined."""
    return F.regexp_replace(_col(name), "[^0-9]", "")


def file_key(name: str | Column, prefix: int = 4, suffix: str = ".jsonl") -> Column:
    """A file name without its leading characters and its suffix."""
    return F.replace(_col(name).substr(F.lit(prefix + 1), F.length(_col(name))), F.lit(suffix), F.lit(""))

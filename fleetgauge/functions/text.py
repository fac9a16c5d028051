"""Completion clean-up as column expressions: no Python runs per row.

Whitespace means what Python's ``str.strip`` means, which is wider than Spark's ``trim``.
Patterns treat only the line feed as a line end.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    CODE_MARKERS,
    DROPPED_LINE_PREFIXES,
    ERROR_MARKERS,
    EXPLANATION_WORDS,
    MIN_COMPLETION_CHARS,
    MIN_SANITIZED_CHARS,
    PREFACES,
    STUB_BODY,
)
from fleetgauge.functions.numbers import let
from fleetgauge.functions.whitespace import WS_CLASS, WS_INLINE_CLASS, lstrip, rstrip, strip

def lines_of(x: Column) -> Column:
    return F.split(x, "\n", -1)


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def preview(x: Column, size: int) -> Column:
    return F.left(x, F.lit(size))


def strip_fences(x: Column) -> Column:
    """Removes an opening code fence (with or without ``python``) and a closing one."""
    opened = F.regexp_replace(strip(x), rf"^(?i:```python{WS_CLASS}*)", "")
    opened = F.regexp_replace(opened, rf"^```{WS_CLASS}*", "")
    return strip(F.regexp_replace(opened, r"```\n?\z", ""))


def strip_preface(x: Column) -> Column:
    """Removes one leading phrase such as ``Here is:``."""
    phrases = "|".join(p.replace(" ", f"{WS_CLASS}+") for p in PREFACES)
    return strip(F.regexp_replace(x, rf"^(?i:{phrases})[:.]?{WS_CLASS}*", ""))


def _after_entry(x: Column, entry_point: Column, keep_signature: bool) -> tuple[Column, Column]:
    marker = F.concat(F.lit("def "), entry_point)
    at = F.call_function("locate", marker, x)
    found = (F.coalesce(entry_point, F.lit("")) != "") & (at > 0)
    after = F.substring(x, at + F.length(marker), F.length(x))
    if not keep_signature:
        after = F.regexp_replace(after, rf"\A[\s\S]*?:{WS_INLINE_CLASS}*(?:\n|\z)", "")
    return found, after


def body_after_def(x: Column, entry_point: Column, compat: bool = False) -> Column:
    """Text after the first ``def <entry_point>``; unchanged if there is none.

    The rest of the signature, up to the first line ending in a colon, is dropped too unless
    ``compat`` asks to keep it.
    """
    found, after = _after_entry(x, entry_point, keep_signature=compat)
    return F.when(found, after).otherwise(x)


def drop_docstrings(x: Column) -> Column:
    """Removes whole docstring lines.

    A line whose first characters are a triple quote opens a docstring and the next such line
    closes it; a line holding exactly two of the same triple quote is a docstring by itself. An
    unclosed docstring runs to the end of the text.
    """
    ws = f"{WS_INLINE_CLASS}*"
    pairs = [
        rf'{q}(?:(?!{q})[^\n])*{q}(?:(?!{q})[^\n])*(?=\n|\z)' for q in ('"""', "'''")
    ]
    other = [
        rf'{a}(?:(?!{b})[^\n])*{b}(?:(?!{b})[^\n])*{b}(?:(?!{b})[^\n])*(?=\n|\z)'
        for a, b in (('"""', "'''"), ("'''", '"""'))
    ]
    single = "|".join(pairs + other)
    quote = r'(?:"""|\'\'\')'
    block = rf"{quote}[^\n]*(?:\z|\n(?:[\s\S]*?\n)??{ws}{quote}[^\n]*|[\s\S]*\z)"
    return F.regexp_replace(x, rf"(?md)^{ws}(?:{single}|{block})\n?", "")


def cut_explanation(x: Column, compat: bool = False) -> Column:
    """Keeps lines before the first fence or prose line.

    Prose starts with a whole word such as ``This`` or ``Note``; ``compat`` accepts the word as
    a mere prefix, which also ends the text at code such as ``items = []``.
    """
    words = "|".join(EXPLANATION_WORDS)
    edge = "" if compat else r"(?:[^\p{L}\p{N}_]|\z)"
    stop = rf"(?md)^{WS_INLINE_CLASS}*(?:```|(?i:{words}){edge})[\s\S]*\z"
    return rstrip(F.regexp_replace(x, stop, ""))


def _shift(lines: Column, base: int, full_only: bool) -> Column:
    """Lines moved sideways together so the shallowest non-blank one starts at ``base``."""

    def moved(measured: Column) -> Column:
        least = F.array_min(
            F.transform(measured, lambda m: F.when(m["rest"] != "", m["width"]))
        )
        return let(least, lambda shared: F.transform(measured, lambda m: placed(m, shared)))

    def placed(m: Column, shared: Column) -> Column:
        if full_only:
            line = F.concat(F.repeat(F.lit(" "), m["width"] - shared + base), m["rest"])
        else:
            rest = F.substring(m["line"], shared + 1, F.length(m["line"]))
            line = F.concat(F.lit(" " * base), rest)
        return F.when(m["rest"] == "", F.lit("")).otherwise(line)

    measured = F.transform(
        lines,
        lambda line: let(
            lstrip(line),
            lambda rest: F.struct(
                line.alias("line"),
                rest.alias("rest"),
                (F.length(line) - F.length(rest)).alias("width"),
            ),
        ),
    )
    if full_only:
        measured = F.filter(measured, lambda m: m["rest"] != "")
    return let(measured, moved)


def reindent(x: Column, base: int = 4) -> Column:
    """Drops blank lines and shifts the rest so the shallowest starts at ``base`` spaces."""
    return rstrip(joined(_shift(lines_of(x), base, full_only=True)))


def dedent(x: Column) -> Column:
    """Removes the indentation all non-blank lines share; blank lines become empty."""
    return joined(_shift(lines_of(x), 0, full_only=False))


def indent(x: Column, base: int = 4) -> Column:
    """Re-bases the text at ``base`` spaces, keeping what follows each line's shared indent."""
    return joined(_shift(lines_of(x), base, full_only=False))


def extract_completion(x: Column, entry_point: Column, compat: bool = False) -> Column:
    """Function body from a raw model answer; empty text when nothing is left.

    The first kept line keeps its own indentation, so nesting survives; ``compat`` strips it, as
    older logs did.
    """

    def bare(text: Column) -> Column:
        return strip(text) if compat else rstrip(_without_leading_blank_lines(text))

    def body(plain: Column) -> Column:
        found, after = _after_entry(plain, entry_point, keep_signature=compat)
        return F.when(found, bare(drop_docstrings(after))).otherwise(plain)

    plain = strip_preface(strip_fences(F.coalesce(x, F.lit(""))))
    kept = bare(_without_statements(let(plain, body)))
    code = cut_explanation(kept, compat)
    return let(code, lambda c: F.when(strip(c) == "", F.lit("")).otherwise(reindent(c)))


def _without_statements(x: Column) -> Column:
    starts = "|".join(DROPPED_LINE_PREFIXES)
    pattern = rf"(?md)^{WS_INLINE_CLASS}*(?:{starts})[^\n]*(?:\n|\z)"
    return F.regexp_replace(x, pattern, "")


def drop_leading_statements(x: Column) -> Column:
    """Drops every import, def and class line."""
    return strip(_without_statements(x))


def _without_leading_blank_lines(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{WS_CLASS}*\n", "")


def validated_body(x: Column) -> Column:
    """Text to evaluate once it parsed: a function on its own at the margin, a body at four
    spaces; nesting and blank lines between stay."""
    kept = rstrip(_without_leading_blank_lines(x))
    return F.when(strip(x).startswith("def "), dedent(kept)).otherwise(indent(kept))


def has_error_marker(x: Column) -> Column:
    hit = F.lit(False)
    for marker in ERROR_MARKERS:
        hit = hit | x.contains(marker)
    return hit


def sanitize_completion(x: Column, compat: bool = False) -> Column:
    """A body safe to evaluate: a stub replaces empty, tiny or error text.

    Text that does not start with four spaces is indented. By default the nesting is kept;
    ``compat`` puts every line at four spaces.
    """
    text = F.coalesce(x, F.lit(""))
    if compat:
        flat = F.transform(
            lines_of(strip(text)),
            lambda line: F.when(strip(line) == "", line).otherwise(
                F.concat(F.lit("    "), lstrip(line))
            ),
        )
        body = joined(flat)
    else:
        body = reindent(text)
    bad = has_error_marker(text) | (F.length(strip(text)) < MIN_SANITIZED_CHARS)
    return F.when(bad, F.lit(STUB_BODY)).otherwise(body)


def long_enough(x: Column) -> Column:
    return F.coalesce(F.length(strip(x)) >= MIN_COMPLETION_CHARS, F.lit(False))


def looks_like_code(x: Column) -> Column:
    hit = F.lit(False)
    for marker in CODE_MARKERS:
        hit = hit | x.contains(marker)
    return F.coalesce(hit, F.lit(False))

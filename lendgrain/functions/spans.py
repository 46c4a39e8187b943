"""Pattern matches with character offsets, snippets around them and span de-duplication.

Spark returns matched texts but not offsets. Here one replacement marks every match with
control characters; cut at the marks, the text falls into matches and the gaps between
them, and each start is the total length of what came before. A pattern is thus scanned
once, whether it matches or not. The expressions are written as SQL text, which keeps
each one a single expression to build and parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendgrain.functions.parsing import strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Marks before a match, after its text, and after each captured group.
MATCH_MARK, TEXT_MARK, GROUP_MARK = "\x01", "\x02", "\x03"


def without_marks(col: Column) -> Column:
    """The text with the mark characters, should it hold any, replaced by another control character."""
    return F.when(col.rlike(r"[\x01-\x03]"), F.translate(col, "\x01\x02\x03", "\x04\x04\x04")).otherwise(col)


def fold_sql(items: str, start: str, state: str, row: str, element: str, keep: str = "true", block: int = 64) -> str:
    """``array<element>`` of what a fold over ``items`` emits, in time proportional to their number.

    ``state``, ``row`` and ``keep`` read the state as ``a.at`` (an int, first ``start``) and the item as ``e``.
    Appending copies an array, so rows are appended to short blocks, and blocks to the outcome.
    """
    inner = (
        f"aggregate(slice(xs, k * {block} + 1, {block}), named_struct('at', acc.at, 'out', CAST(array() AS array<{element}>)), "
        f"(a, e) -> named_struct('at', {state}, 'out', CASE WHEN {keep} THEN concat(a.out, array({row})) ELSE a.out END))")
    return (
        f"get(transform(array({items}), xs -> aggregate(sequence(0, (size(xs) - 1) div {block}), "
        f"named_struct('at', {start}, 'out', CAST(array() AS array<array<{element}>>)), (acc, k) -> get(transform(array({inner}), "
        "part -> named_struct('at', part.at, 'out', concat(acc.out, array(part.out)))), 0), acc -> flatten(acc.out))), 0)")


def spans_sql(name: str, pattern: str, groups: int = 0, needles: tuple[str, ...] = ()) -> str:
    """``array<struct<start,end,text,g1..>>`` of all matches in column ``name``, in text order.

    Offsets are zero-based. The column must be free of mark characters. ``needles``: strings every match
    holds, each with its alternatives ("profit|loss"); a plain search for them spares other texts the pattern.
    """
    captures = [f"g{i}" for i in range(1, groups + 1)]
    mark = MATCH_MARK + "$0" + TEXT_MARK + "".join(f"${i}{GROUP_MARK}" for i in range(1, groups + 1))
    last = GROUP_MARK if groups else TEXT_MARK
    text = f"substring_index(e, '{TEXT_MARK}', 1)"
    captured = lambda n: (
        f"substring_index(substring_index(substring_index(e, '{TEXT_MARK}', -1), '{GROUP_MARK}', {n}), '{GROUP_MARK}', -1)")
    row = ", ".join([f"'start', a.at, 'end', a.at + length({text}), 'text', {text}"] + [
        f"'{g}', {captured(n)}" for n, g in enumerate(captures, 1)])
    element = "struct<start:int,end:int,text:string" + "".join(f",{g}:string" for g in captures) + ">"
    found = fold_sql(
        "slice(b, 2, size(b) - 1)", "length(get(b, 0))", f"a.at + length({text}) + length(substring_index(e, '{last}', -1))",
        f"named_struct({row})", element)
    every = (
        f"get(transform(array(split(regexp_replace({name}, {literal(pattern)}, '{mark}'), '{MATCH_MARK}', -1)), b -> "
        f"CASE WHEN size(b) > 1 THEN {found} ELSE CAST(array() AS array<{element}>) END), 0)")
    held = " AND ".join(
        "(" + " OR ".join(f"contains({name}, {literal(word)})" for word in needle.split("|")) + ")" for needle in needles)
    return f"CASE WHEN {held} THEN {every} ELSE CAST(array() AS array<{element}>) END" if needles else every


def spans(name: str, pattern: str, groups: int = 0) -> Column:
    return F.expr(spans_sql(name, pattern, groups))


def labelled_spans(name: str, patterns: list[tuple[str, str]]) -> Column:
    """Spans of several labelled patterns in start order, without overlaps.

    On equal starts the earlier pattern goes first. A span is dropped if it starts
    before the last kept one ends.
    """
    tagged = ", ".join(
        f"transform({spans_sql(name, pattern)}, m -> named_struct('start', m.start, 'ord', {n}, 'end', m.end, "
        f"'label', {literal(label)}))" for n, (label, pattern) in enumerate(patterns))
    element = "struct<start:int,ord:int,end:int,label:string>"
    return F.expr(
        f"get(transform(array(array_sort(concat({tagged}))), ms -> CASE WHEN size(ms) < 2 THEN ms ELSE "
        + fold_sql("ms", "0", "IF(e.start >= a.at, e.end, a.at)", "e", element, keep="e.start >= a.at") + " END), 0)")


def window_sql(name: str, start: str, end: str, before: int, after: int) -> str:
    return (f"substring({name}, greatest({start} - {before}, 0) + 1, "
            f"least(length({name}), {end} + {after}) - greatest({start} - {before}, 0))")


def window_text(col: Column, start: Column, end: Column, before: int | Column, after: int | Column) -> Column:
    """Text from ``before`` characters ahead of the span to ``after`` behind it."""
    low = F.greatest(start - before, F.lit(0))
    high = F.least(F.length(col), end + after)
    return F.substring(col, low + 1, high - low)


def snippet(col: Column, start: Column, end: Column, before: int | Column, after: int | Column) -> Column:
    return strip(window_text(col, start, end, before, after))

"""Column functions that turn raw statement text into timestamps and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of the accepted timestamp texts.
CLOCK = r" \d{1,2}:\d{1,2}(:\d{1,2})?"
TIMESTAMP_SHAPES = [
    rf"\d{{1,2}}-\d{{1,2}}-\d{{4}}({CLOCK})?",
    rf"\d{{1,2}}/\d{{1,2}}/\d{{4}}({CLOCK})?",
    r"\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2})?",
    r"\d{1,2}-[A-Za-z]{3}-\d{4}( \d{1,2}:\d{1,2}:\d{1,2})?",
    r"\d{1,2} [A-Za-z]{3} \d{4}( \d{1,2}:\d{1,2}:\d{1,2})?",
]
# The three layouts left once separators are dashes and a time is present.
TIMESTAMP_LAYOUTS = [
    (r"^\d{4}", "yyyy-M-d H:m:s"), (r"^\d{1,2}-\d", "d-M-yyyy H:m:s"), (r"^\d{1,2}-[A-Za-z]", "d-MMM-yyyy H:m:s"),
]
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?$"
)
WHITESPACE = " \t\n\r\f\u000b"


def strip(col: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def computed_once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated once.

    A one-element generator: filters on the column stay above it, where a plain
    projection would have the optimizer copy the whole expression into the filter.
    """
    return frame.withColumn(name, F.explode(F.array(value)))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def with_ts(frame: DataFrame, source: str, out: str = "ts") -> DataFrame:
    """Add the wall-clock timestamp of a text column, null where no known layout fits.

    ISO texts are cast; the others are brought to three layouts, so each is parsed once.
    """
    text, even = F.col("_text"), F.col("_even")
    head = strip(F.substring_index(text, ".", 1))
    dashed = F.regexp_replace(F.replace(head, F.lit("/"), F.lit("-")), r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4})", "$1-$2-$3")
    timed = F.regexp_replace(dashed, r"^(\d+-\w+-\d+)T", "$1 ")
    timed = F.regexp_replace(timed, r"^(\S+)$", "$1 00:00:00")
    full = F.regexp_replace(timed, r"^(\S+ \d{1,2}:\d{1,2})$", "$1:00")
    known = "^(" + "|".join(TIMESTAMP_SHAPES) + ")$"
    staged = frame.withColumn("_text", strip(F.col(source))).withColumns({
        "_iso": F.when(text.rlike(ISO_SHAPE), F.when(
            F.length(text) > 10, F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).otherwise(text)),
        "_even": F.when(head.rlike(known), full)})
    parsed = F.when(F.col("_iso").isNotNull(), F.col("_iso").try_cast("timestamp_ntz"))
    for shape, layout in TIMESTAMP_LAYOUTS:
        parsed = parsed.when(even.rlike(shape), F.try_to_timestamp(even, F.lit(layout)).cast("timestamp_ntz"))
    return computed_once(staged, out, parsed).drop("_text", "_iso", "_even")


def parse_amount(col: Column) -> Column:
    """Digits and dots of the text as a number; blank or malformed text is zero."""
    return F.coalesce(F.regexp_replace(col, r"[^0-9.]", "").try_cast("double"), F.lit(0.0))


def micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, whatever the session time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
        + seconds.cast("bigint") * F.lit(1_000_000)
        + (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    )

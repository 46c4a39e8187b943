"""Counterparty name from the narration of a bank transaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain.functions.parsing import computed_once, strip
from lendgrain.functions.text import first_chars

# Narrations that never name a counterparty.
NO_PARTY = [
    "SERVICE CHARGE", "ATM WDL", "ATM CASH", "REVERSAL", "INTEREST ",
    "SMS ALERT", "DEMAT", "ONLINE BANKING", "NEFT/RTGS CHARGE",
]
# Trailing markers of the dash layout, and words that are not names.
TRAILING_MARKERS = ["/NONE", "/URGENT/", "/URGENT", "--"]
NOT_A_NAME = ["NONE", "URGENT"]
NAME_LENGTH = 40
CASH_NAME_LENGTH = 30


def _named(candidate: Column, longer_than: int, keep: int | None) -> Column:
    return F.when(F.length(candidate) > longer_than, first_chars(candidate, keep))


def _segment(text: Column, separator: str, number: int) -> Column:
    """The numbered segment, or with -1 the last one."""
    upto = text if number < 0 else F.substring_index(text, separator, number)
    return strip(F.substring_index(upto, separator, -1))


def _count(text: Column, separator: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(separator), F.lit("")))


def with_party(
    txns: DataFrame, description: str = "description", out: str = "party", keep: int | None = NAME_LENGTH,
    keep_cash: int | None = CASH_NAME_LENGTH,
) -> DataFrame:
    """Add the name of the other side, null where the narration carries none.

    Names are cut at ``keep`` characters, those of cash at ``keep_cash``; None keeps them whole, so
    that long names with a common beginning stay apart.

    The narration is cleaned and its layout decided once, in projections of their own;
    names are then cut out with plain string functions, without patterns.
    """
    text, slashes, dashes = F.col("_text"), F.col("_slashes"), F.col("_dashes")
    silent = reduce(lambda a, b: a | b, [text.contains(word) for word in NO_PARTY])
    wired, imps = text.startswith("NEFT") | text.startswith("RTGS"), text.contains("IMPS")
    cut = txns.withColumn("_text", strip(F.upper(description))).withColumns({
        "_slashes": _count(text, "/"), "_dashes": _count(text, "-"), "_wired": wired,
        "_silent": silent | (text.contains("CASH") & text.contains("SELF"))})
    from_fourth = F.substring(text, F.length(F.substring_index(text, "-", 3)) + 2, F.length(text))
    bare = strip(F.rtrim(strip(from_fourth), F.lit("-")))
    bare = reduce(lambda c, m: strip(F.replace(c, F.lit(m), F.lit(""))), TRAILING_MARKERS, bare)
    cut = cut.withColumns({
        "_upi": F.when((text.startswith("UPI/") | text.startswith("UPI-")) & (slashes >= 3), _segment(text, "/", 4)),
        "_tail": F.when(F.col("_wired") & (slashes >= 2), F.rtrim(_segment(text, "/", -1), F.lit("-"))),
        "_wire": F.when(F.col("_wired") & (dashes >= 3), strip(F.btrim(bare, F.lit("-"))))})
    tail, wire = F.col("_tail"), F.col("_wire")
    name = (
        F.when(F.col("_silent"), F.lit(None))
        .when(F.length("_upi") > 2, first_chars(F.col("_upi"), keep))
        .when(F.col("_wired"), F.when(
            (F.length(tail) > 3) & ~tail.isin(*NOT_A_NAME), first_chars(tail, keep)).otherwise(_named(wire, 2, keep)))
        .when(imps & text.contains("SALARY TRF BY-"), _named(_segment(text, "SALARY TRF BY-", -1), 2, keep))
        .when(imps & (dashes >= 2), first_chars(_segment(text, "-", -1), keep))
        .when(text.startswith("BY CLG") & text.contains(","), _named(_segment(text, ",", -1), 2, keep))
        .when((text.contains("CHQ PAID") | text.contains("CHEQUE")) & (dashes >= 2),
              first_chars(_segment(text, "-", 3), keep))
        .when(text.contains("DIVIDEND") & (dashes >= 1), first_chars(_segment(text, "-", 2), keep))
        .when(text.startswith("CASH") & (dashes >= 1), first_chars(_segment(text, "-", -1), keep_cash))
    )
    named = computed_once(cut.withColumn("_name", name), out, F.when(F.length("_name") > 0, F.col("_name")))
    return named.select(*txns.columns, out)

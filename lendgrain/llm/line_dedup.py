"""Lines that repeat an earlier line, up to one edit, by a deletion-neighbourhood join.

A line goes if an earlier one (by doc_id, then line number) equals it or differs by one character
inserted, deleted or replaced; of equal or alike lines the earliest stays. Lines are compared
without blanks at their ends. For lines shorter than ``min_chars`` one edit says too much: they
go with ``short`` if they equal an earlier line, as in op7 and the pipeline, else they are left
alone. Blank lines stay.

Equal lines are folded first, by hash. A line's deletion variants are then hashed keys, and two
lines within one edit share one: a replacement shows as equal variants at one place, an insertion
as a variant that equals the other line. Emitting every variant of every line would square a
line's length, so the place of the edit is narrowed first: two lines within one edit agree before
and after some piece of the line. Keys of the halves, then of pieces of pieces, keep only places
where two different lines agree; character variants are emitted there alone. All of this is exact
for any length. Each key hands its earliest line to the others (a minimum per key, combined before
the shuffle), so no pairs are made within a key, and the Levenshtein distance of each line to the
witness it was handed is checked.

Null texts are empty and stay null. Rows without doc_id are returned as they are. Copies of a row
are one document to this operator: their lines don't repeat each other. Rows of one doc_id with
different texts are different documents, told apart, and ordered, by a hash of the text. Documents
keep their other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.frames import rows_of_ids, settled
from lendgrain.llm.quality_rules import let
from lendgrain.session import settle

BLANKS = " \t\x0b\x0c\r"
#: Pieces that a place is cut into, level by level, after the halves.
PIECES = (8, 4)


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, copy (hash of the text), no, line (trimmed) and its two hashes, for lines that are compared."""
    lines = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    trimmed = lines.select("doc_id", "copy", "no", F.btrim("line", F.lit(BLANKS)).alias("line"))
    return trimmed.filter(F.length("line") >= min_chars).select(
        "*", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2"))


def around(line: Column, basis: Column, low: Column, high: Column) -> Column:
    """Key of what a line of ``basis`` characters (or one more) has before ``low`` and from ``high`` on."""
    return F.xxhash64(basis, low, F.left(line, low), F.right(line, basis - high))


def halves(line: Column) -> Column:
    """Places (basis, low, high, key) of the halves of a line, as it is and as one character more than another."""
    size = F.length(line)
    cut = [(basis, low, high) for basis in (size, size - 1)
           for low, high in ((F.lit(0), F.floor(basis / 2).cast("int")), (F.floor(basis / 2).cast("int"), basis))]
    return F.array(*[F.struct(b.alias("basis"), lo.alias("low"), hi.alias("high"), around(line, b, lo, hi).alias("key"))
                     for b, lo, hi in cut])


def agreeing(places: DataFrame) -> DataFrame:
    """Places whose key two different lines have."""
    shared = places.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most")
    return places.join(shared.select("key"), "key", "left_semi").drop("key").distinct()


def narrowed(places: DataFrame, lines: DataFrame, pieces: int) -> DataFrame:
    step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / pieces).cast("int"))
    starts = F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1, step)).otherwise(F.array("low"))
    cut = places.join(lines, "id").select("id", "basis", "line", "high", step.alias("step"), F.explode(starts).alias("low"))
    cut = cut.withColumn("high", F.least(F.col("low") + F.col("step"), "high"))
    return agreeing(cut.select(
        "id", "basis", "low", "high", around(F.col("line"), F.col("basis"), F.col("low"), F.col("high")).alias("key")))


def variants(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, role, id, place): replaced characters (r), whole lines (w), lines less one character (d)."""
    line, basis, i = F.col("line"), F.col("basis"), F.col("i")
    at = places.join(lines, "id").withColumn("i", F.explode(F.sequence("low", "high")))
    whole = F.length(line) == basis
    role = F.when(~whole, "d").when(i < F.col("high"), "r").otherwise("w")
    rest = F.concat(F.left(line, i), F.right(line, basis - i))
    key = F.when(role == "r", F.xxhash64(F.lit("r"), basis, i, F.left(line, i), F.right(line, basis - i - 1))).otherwise(
        F.xxhash64(F.lit("d"), rest))
    return at.select(key.alias("key"), role.alias("role"), "id", "place").distinct()


def near_repeats(distinct_lines: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """Ids of distinct lines (id, place, halves) that an earlier line is one edit away from."""
    each = distinct_lines.select("id", F.inline("halves"))
    places = settle(agreeing(each))
    found = settle(distinct_lines.join(places.select("id").distinct(), "id", "left_semi").select(
        "id", "place", "place.doc_id", "place.copy", "place.no"))
    holders = rows_of_ids(docs, found.select("doc_id").distinct(), "doc_id")
    texts = lines_of(holders, min_chars).select("doc_id", "copy", "no", "id", "line").dropDuplicates(["doc_id", "copy", "no"])
    at = ["doc_id", "copy", "no", "id"]
    lines = settle(texts.join(found.select(*at, "place"), at).select("id", "place", "line"))
    text_of = lines.select("id", "line")
    for pieces in PIECES:
        places = settle(narrowed(places, text_of, pieces))
    emitted = settle(variants(places, lines))
    earliest = emitted.groupBy("key").agg(
        F.min("place").alias("any_place"), F.min(F.when(F.col("role") == "w", F.col("place"))).alias("w_place"),
        F.min(F.when(F.col("role") == "d", F.col("place"))).alias("d_place"))
    witness = F.when(F.col("role") == "r", F.col("any_place")).when(F.col("role") == "d", F.col("w_place")).otherwise(F.col("d_place"))
    pairs = emitted.join(earliest, "key").withColumn("witness", witness).filter("witness < place").select("id", "witness").distinct()
    near = pairs.join(text_of, "id").join(lines.select(F.col("place").alias("witness"), F.col("line").alias("other")), "witness")
    return near.filter(F.levenshtein("line", "other", 1).between(0, 1)).select("id").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = 10, short: bool = False) -> DataFrame:
    """Per document with any: doc_id, copy (hash of its text) and drop, the numbers of its lines that go."""
    docs = docs.select("doc_id", "text")
    lines = lines_of(docs, 1 if short else min_chars)
    places = F.when(F.length("line") >= min_chars, halves(F.col("line")))
    known = settled(lines.groupBy("id", "id2").agg(
        F.min(F.struct("doc_id", "copy", "no")).alias("place"), F.count(F.lit(1)).alias("n"), F.any_value(places).alias("halves")))
    near = settled(near_repeats(known.select("id", "place", "halves"), docs, min_chars)).withColumn("near", F.lit(True))
    verdict = known.select("id", "id2", "place", "n").join(near, "id", "left").filter("n > 1 OR near")
    gone = lines.select("doc_id", "copy", "no", "id", "id2").join(verdict, ["id", "id2"]).filter(
        F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "copy", "no") != F.col("place")))
    return gone.groupBy("doc_id", "copy").agg(F.collect_set("no").alias("drop"))


def without_lines(text: Column, drop: Column) -> Column:
    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")
    return let(F.split(text, "\n"), rest)


def deduplicated(docs: DataFrame, min_chars: int = 10, short: bool = False) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and n_removed, the lines cut (in place of a column of that name)."""
    docs = docs.drop("n_removed")
    gone = settled(repeated_lines(docs, min_chars, short))
    gone = gone.select("doc_id", F.col("copy").alias("_copy"), F.col("drop").alias("_drop"))
    copies, named = gone.select("doc_id", "_copy"), docs.withColumn("_copy", F.xxhash64("text"))
    kept = rows_of_ids(named, copies, ["doc_id", "_copy"], how="left_anti").withColumn("n_removed", F.lit(0).cast("long")).drop("_copy")
    cut = rows_of_ids(named, copies, ["doc_id", "_copy"]).join(gone, ["doc_id", "_copy"])
    cut = cut.withColumn("text", without_lines(F.col("text"), F.col("_drop"))).withColumn("n_removed", F.size("_drop").cast("long"))
    return kept.unionByName(cut.select(*docs.columns, "n_removed"))

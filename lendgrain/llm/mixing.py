"""Mixing sources to target weights by drawing fixed-length blocks of words.

Each source's documents, in a fixed pseudorandom order, are one stream of words cut into blocks
of equal length. Sources get target words by weight; no target passes ``cap`` times its source's
size, the excess is shared out anew by weight. The mix is a row of slots, one block each, in
output shards of ``SHARD_SLOTS``. A shard draws how many slots each source gets: a multinomial
draw, stratified both within the shard and over the shards, so that each source's total stays
within about two blocks of its target. A source's slots count up through the shards; slot j
shows block perm(j mod blocks) of pass j div blocks, where perm is a swap-or-not shuffle keyed by
source and pass. So a block is seen at most ``cap`` times, and blocks and slots meet in an
equality join on (source, block).

Everything is DataFrame expressions; draws are hashes of the seed, so reruns agree, whatever the
partitioning. Offsets in a source come from chunk totals (by hash of doc_id, ``CHUNKS`` per
source), so no task sees a whole source. Null texts have size 0, a null source is a source and
comes last, repeated rows are documents of their own, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.llm.quality_rules import let
from lendgrain.session import settle

WORD = r"[^\x20\x09-\x0D]+"
CHUNKS, BLOCK_WORDS, LEAST_BLOCKS, SHARD_SLOTS, LEAST_SHARDS, ROUNDS = 4096, 512, 256, 16_384, 16, 10


def sized(docs: DataFrame, also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, source, size in words, and further columns that tell rows of one doc_id apart."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"), *also)


def unit(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11) / F.lit(float(2**53))


def permuted(at: Column, n: Column, key: Column) -> Column:
    """Place of ``at`` in a pseudorandom permutation of 0 .. n - 1 chosen by ``key``.

    Swap-or-not: in each round x and its mirror image about a keyed point change places or not,
    as a hash of the pair says; so each round is a bijection, for any n.
    """
    def change(x: Column, r: Column) -> Column:
        def swapped(mirror: Column) -> Column:
            odd = F.xxhash64(key, r + ROUNDS, F.greatest(mirror, x)).bitwiseAND(F.lit(1)) == 1
            return F.when(odd, mirror).otherwise(x)
        return let(F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n), swapped)
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), at.cast("long"), change)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per source: rank, source, source_size and target, in words.

    Filling up by weight until the caps hold: sources by rising cap per weight stay capped up to
    the first whose share of what the capped ones leave is below its own cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("rank", F.row_number().over(in_order).cast("long"))
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")]
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    rising = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = ranked.withColumn("share", left / F.sum("weight").over(onward)).withColumn("place", F.row_number().over(rising))
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("most"), F.struct("place", "share"))).over(everything)
    return share.withColumn("target", F.least(F.col("most").cast("double"), level["share"] * F.col("weight"))).select(
        "rank", "source", "source_size", "target")


def blocked(sources: DataFrame, block_words: int = BLOCK_WORDS, cap: int = 3) -> DataFrame:
    """Add each source's block length, number of blocks and slots wanted; small sources have shorter blocks."""
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    cut = sources.withColumn("block_words", length)
    cut = cut.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    return cut.withColumn("wanted", wanted).withColumn("most_slots", F.col("blocks") * cap)


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """One row per slot: shard, position in it, rank, block."""
    up_to = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    drawn = (
        sources.withColumn("all_slots", F.sum("wanted").over(whole)).withColumn("edge", F.sum("wanted").over(up_to))
        .withColumn("shards", F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("all_slots") / SHARD_SLOTS)).cast("long"))
    )
    edges = drawn.select(
        "rank", "blocks", "most_slots", "shards",
        ((F.col("edge") - F.col("wanted")) / F.col("shards")).alias("low"), (F.col("edge") / F.col("shards")).alias("high"))
    shards = edges.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    for side in ("low", "high"):
        # the stratum that an edge cuts goes to the lower source in as many shards as its share says
        keyed = shards.withColumn("_key", F.xxhash64(F.lit(seed), F.floor(side)))
        keyed = keyed.withColumn("_turn", permuted(F.col("shard"), F.col("shards"), F.col("_key")))
        chance = (F.col("_turn") + unit(F.col("_key"), F.col("shard"))) / F.col("shards")
        taken = F.when(chance < F.col(side) - F.floor(side), F.lit(1)).otherwise(F.lit(0))
        shards = keyed.withColumn(side + "_slot", F.floor(side) + taken).drop("_key", "_turn")
    counted = shards.withColumn("count", F.col("high_slot") - F.col("low_slot")).filter("count > 0")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    each = counted.select(
        "rank", "blocks", "most_slots", "shard", "base", "low_slot",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    each = each.withColumn("j", F.col("base") + F.col("i")).filter("j < most_slots")
    each = each.withColumn("_at", F.pmod("j", "blocks")).withColumn("_key", F.xxhash64(F.lit(seed), "rank", F.expr("j div blocks")))
    return each.select(
        "shard", (F.col("low_slot") + F.col("i")).alias("position"), "rank",
        permuted(F.col("_at"), F.col("blocks"), F.col("_key")).alias("block"))


def spans(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Per document and block: the words of the document in the block.

    Columns: rank, chunk and row (a document's identity), doc_id, source, size, source_size,
    target, block, first_word, n_words. A document without words has one row with a null block.
    """
    also = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    named = sources.select("rank", F.col("source").alias("_source"), "source_size", "target", "block_words")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CHUNKS)))
    totals = rows.groupBy("rank", "chunk").agg(F.sum("size").alias("words"))
    by_chunk = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("rank", "chunk", F.coalesce(F.sum("words").over(by_chunk), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", *also)
    placed = (
        rows.withColumn("row", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(carried, ["rank", "chunk"]).withColumn("end", F.col("end") + F.col("carried"))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    touched = F.when(F.col("size") > 0, F.expr("sequence(begin div block_words, (end - 1) div block_words)"))
    low = F.greatest(F.col("begin"), F.col("block") * F.col("block_words"))
    high = F.least(F.col("end"), (F.col("block") + 1) * F.col("block_words"))
    return placed.select("*", F.explode_outer(touched).alias("block")).select(
        "rank", "chunk", "row", "doc_id", "source", "size", "source_size", "target", *also, "block",
        (low - F.col("begin")).alias("first_word"), (high - low).alias("n_words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block_words: int = BLOCK_WORDS,
        seed: int = 20, also: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix as (slots, spans): join them on (rank, block) and order by shard and position for its words.

    Slots come of a few rows exploded, which Spark takes for a small table: join them with a merge hint.
    """
    sizes = settle(sized(docs, also))
    sources = settle(blocked(targets(sizes, weights, cap), block_words, cap))
    return slots(sources, seed), spans(sizes, sources, seed)


def mixed_spans(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: for every slot the stretches of words that it shows, in order."""
    drawn, held = mix(docs, **options)
    return drawn.hint("merge").join(held, ["rank", "block"]).select(
        "shard", "position", "source", "block", "doc_id", "first_word", "n_words")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it."""
    drawn, held = mix(docs, **options)
    uses = drawn.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))
    seen = held.join(uses.hint("merge"), ["rank", "block"], "left")
    return seen.groupBy("rank", "chunk", "row", "doc_id", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("uses") * F.col("n_words")), F.lit(0)).alias("taken")
    ).drop("rank", "chunk", "row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words of: the columns of ``taken_words``, text and stretches.

    ``stretches`` are (shard, position, first_word, n_words) in that order: the slots that show the document,
    and which of its words. All stretches of all documents by shard and position are the mix.
    """
    keys = [F.xxhash64("doc_id", "text").alias("text_id"), F.xxhash64(F.lit(7), "doc_id", "text").alias("text_id2")]
    drawn, held = mix(docs, also=tuple(keys), **options)
    shown = drawn.groupBy("rank", "block").agg(
        F.count(F.lit(1)).alias("uses"), F.collect_list(F.struct("shard", "position")).alias("shown"))
    stretches = F.transform("shown", lambda at: F.struct(
        at["shard"].alias("shard"), at["position"].alias("position"), F.col("first_word"), F.col("n_words")))
    taken = held.join(shown.hint("merge"), ["rank", "block"]).groupBy(
        "rank", "chunk", "row", "doc_id", "source", "size", "source_size", "target", "text_id", "text_id2"
    ).agg(F.sum(F.col("uses") * F.col("n_words")).alias("taken"),
          F.sort_array(F.flatten(F.collect_list(stretches))).alias("stretches"))
    texts = docs.select(*keys, "text").dropDuplicates(["text_id", "text_id2"])
    return taken.join(texts, ["text_id", "text_id2"]).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "text", "stretches")

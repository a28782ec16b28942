"""Mixing sources to target weights by blocks, shards and index permutations.

Each source's words are packed, document after document, into blocks of a fixed
length. Output shards draw multinomial counts of slots over the sources; a last
settling shard takes what the draws fell short of, and draws beyond a source's
number of slots are void, so each source gets exactly its slots. The j-th slot of a
source reads block ``permutation[j // blocks](j % blocks)`` of it: a keyed Feistel
permutation per source and epoch, so no block is read again before all were read.
Slots and blocks join on (source, block).

What is collected is one row per source (name and size); more sources than
``MAX_SOURCES`` raise an error. Everything else is distributed: running totals are
taken within hashed chunks of a source and then over chunks, so a source with a
third of all rows is no single task's work.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; a source without words has target 0; repeated
rows are documents of their own; an empty table gives an empty result; extra
columns are not read. Reruns give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import fresh_name, shuffle_partitions, stage
from .words import mixed, word_count

#: Weights by order of the source's name, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MAX_REPEATS = 3
BLOCK_WORDS = 64
SLOTS_PER_SHARD = 8192
#: Bound of the collected source table (about 100 MB).
MAX_SOURCES = 1_000_000
#: Documents in a chunk of running totals, about.
CHUNK_ROWS = 2048
SEED = 20_240_501


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> list[float]:
    """Words wanted from each source, given sizes in order of name.

    All sources share the sum of sizes by weight; a target above ``repeats`` times its
    source's size stops there, and the excess is shared again until none is above.
    """
    share = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    # In order of the level at which a source is full, each source is full or all later ones are not.
    order = sorted(range(len(sizes)), key=lambda k: repeats * sizes[k] / share[k])
    left, weight = float(sum(sizes)), sum(share)
    for k in order:
        out[k] = min(float(repeats * sizes[k]), left * share[k] / weight)
        left, weight = left - out[k], weight - share[k]
    return out


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of range(size), applied to ``index``: four rounds, walking cycles until inside."""
    if size <= 1:
        return np.zeros_like(index)
    half = np.uint64(max(1, (int(size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int(x)) for x in np.random.Generator(np.random.Philox(key=key)).integers(0, 1 << 63, 4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def shard_draws(probabilities: list[float], slots: int, per_shard: int, seed: int):
    """Function for ``mapInArrow``: shard numbers to (shard, src, n)."""
    p = np.asarray(probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                n = rng.multinomial(min(per_shard, slots - shard * per_shard), p)
                src = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard)), pa.array(src.astype(np.int32)), pa.array(n[src].astype(np.int64))], ["shard", "src", "n"])

    return run


def slot_blocks(seed: int):
    """Function for ``mapInArrow``: (src, n_blocks, first, n) to the block of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, size, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                slot = np.arange(first, first + n)
                block = np.empty(n, np.int64)
                for epoch in range(int(first // size), int((first + n - 1) // size) + 1):
                    here = slot // size == epoch
                    block[here] = feistel(slot[here] % size, size, (seed << 64) | (src << 8) | epoch)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, src, np.int32)), pa.array(block)], ["src", "block"])

    return run


def _sized(docs: DataFrame, *extra) -> DataFrame:
    return stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra), "sizes")


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """Words taken of each row of a staged (doc_id, source, size, ...): adds src, start, chunk, source_size, target, taken."""
    spark = sized.sparkSession
    n_rows = sized.count()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if by_source.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(((r.source, r.source_size) for r in by_source.collect()), key=lambda s: (s[0] is None, s[0] or ""))
    goal = targets([n for _, n in sources])
    blocks = [-(-n // block_words) for _, n in sources]
    slots = [min(MAX_REPEATS * b, round(t * b / n)) if n else 0 for (_, n), b, t in zip(sources, blocks, goal)]
    table = spark.createDataFrame([(k, name, n, t, b) for k, ((name, n), t, b) in enumerate(zip(sources, goal, blocks))], "src int, __source string, source_size long, target double, n_blocks long")

    chunks = max(1, n_rows // CHUNK_ROWS)
    rest = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    # Ids may be null or repeated, so all that is known of a row deals it.
    named = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", *rest), F.lit(chunks)).cast("int"))
    named = named.join(table, named["source"].eqNullSafe(table["__source"])).drop("__source", "n_blocks")
    within = Window.partitionBy("src", "chunk").orderBy("doc_id", "size", *rest).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy("src", "chunk").agg(F.sum("size").alias("n")).select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Rows without words take no place, however many there are of them.
    counted = named.filter("size > 0").withColumn("upto", F.sum("size").over(within)).join(totals, ["src", "chunk"])
    placed = counted.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("base", "upto")
    empty = named.filter("size = 0").withColumn("start", F.lit(0).cast("long"))
    placed = stage(placed.unionByName(empty), "placed")

    width = F.lit(block_words)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width) - F.greatest(F.col("start"), F.col("block") * width)
    times = _slot_counts(spark, slots, blocks, per_shard, seed)
    keys = placed.columns
    read = pieces.withColumn("words", words).join(times, ["src", "block"], "left")
    taken = read.groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    return taken.unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))


def _slot_counts(spark: SparkSession, slots: list[int], blocks: list[int], per_shard: int, seed: int) -> DataFrame:
    """(src, block, times): how often each block that any slot reads is read."""
    total = sum(slots)
    shards = -(-total // per_shard)
    plan = spark.createDataFrame([(k, s, b) for k, (s, b) in enumerate(zip(slots, blocks)) if s], "src int, slots long, n_blocks long")
    if not total:
        return spark.createDataFrame([], "src int, block long, times long")
    p = [s / math.fsum(slots) for s in slots]
    drawn = spark.range(shards).mapInArrow(shard_draws(p, total, per_shard, seed), "shard long, src int, n long")
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, "src")
    kept = drawn.select("src", "n_blocks", "first", F.least(F.col("n"), F.col("slots") - F.col("first")).alias("n"))
    reached = drawn.groupBy("src").agg(F.sum("n").alias("first"))
    settled = plan.join(reached, "src", "left").select("src", "n_blocks", F.coalesce(F.col("first"), F.lit(0)).alias("first"), (F.col("slots") - F.coalesce(F.col("first"), F.lit(0))).alias("n"))
    runs = kept.unionByName(settled).filter("n > 0")
    step = F.lit(per_shard)
    split = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step)))).select(
        "src", "n_blocks", (F.col("first") + F.col("k") * step).alias("first"), F.least(step, F.col("n") - F.col("k") * step).alias("n")
    )
    # So many tasks whatever the bytes: a row of a few bytes stands for thousands of slots.
    return split.repartition(shuffle_partitions(spark), "src", "first").mapInArrow(slot_blocks(seed), "src int, block long").groupBy("src", "block").agg(F.count("*").alias("times"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix reads it, rounded.

    Times read (taken / size) are rounded by running totals in order of size within a
    chunk of a source, so that the words of a source still add up near its target.
    Documents read less than once in all drop out; those without words stay once.
    """
    taken = mix(_sized(docs, F.xxhash64("text").alias("hash")))
    run = Window.partitionBy("src", "chunk").orderBy("size", "start", "doc_id", "hash")
    reads = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    upto = taken.withColumn("upto", F.sum(reads).over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(0.5))
    copies = F.floor("upto") - F.floor(F.coalesce(F.lag("upto").over(run), F.lit(0.5)))
    each = upto.select("doc_id", "hash", "source", F.when(F.col("size") > 0, copies).otherwise(F.lit(1)).alias("copies"))
    decided = stage(each.groupBy("doc_id", "hash", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "copies")
    name, times = fresh_name(docs, "hash"), fresh_name(docs, "copies")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    if not decided.filter("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", name, "source"])
    same = keyed["doc_id"].eqNullSafe(decided["doc_id"]) & (keyed[name] == decided["hash"]) & keyed["source"].eqNullSafe(decided["source"])
    out = keyed.join(decided.filter("copies > 0").hint("merge"), same).select(*[keyed[c] for c in docs.columns], decided["copies"].alias(times))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of each source, and the words of its documents, by the operator."""
    taken = mix(_sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    per = taken.groupBy("source", "source_size", F.round("target", 3).alias("target"))
    return per.agg(F.sum("size").alias("words"), F.count("*").alias("n_docs"))


#: Sources in order of the level at which they are full: the full ones come first, and the rest shares what they leave.
MIXING_SQL = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n, count(*) AS n_docs FROM documents GROUP BY source),
  w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS share FROM s),
  o AS (SELECT *, sum(3 * n) OVER up AS full_upto, sum(share) OVER up AS share_upto, sum(n) OVER () AS total, sum(share) OVER () AS shares
        FROM w WINDOW up AS (ORDER BY 3 * n / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  f AS (SELECT *, 3 * n <= (total - (full_upto - 3 * n)) * share / (shares - (share_upto - share)) AS is_full FROM o),
  r AS (SELECT total - coalesce(sum(3 * n) FILTER (is_full) OVER (), 0) AS rest, shares - coalesce(sum(share) FILTER (is_full) OVER (), 0) AS rest_shares, * FROM f)
SELECT source, n AS source_size, round(CASE WHEN is_full THEN 3.0 * n ELSE rest * share / rest_shares END, 3) AS target, n AS words, n_docs FROM r
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(_sized(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.xxhash64("text").alias("hash")))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")

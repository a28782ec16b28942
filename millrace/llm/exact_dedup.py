"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. A new
batch is reduced to its distinct digests, sort-merge anti-joined with the index
on the bucketing key, and what is new is appended. Only DataFrame operations are
used, and only 32-byte digests are shuffled, never texts.

Defined cases: a null text counts as empty; within a batch the largest doc_id of
equal texts stays (a null id only when no other is there), and a digest that the
index already holds keeps the id stored first. Rows that repeat both doc_id and
text are one document more than once: each counts in ``group_size`` and exactly
one has ``kept``. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import spread_join
from .staging import discard, fresh_name, shuffle_partitions, stage


def text_digest(text: Column) -> Column:
    """Binary SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A bucketed table of the digests seen so far and the id kept for each."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(self.table):
            schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType())])
            self._append(spark.createDataFrame([], schema))

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.select("digest", "keep_id").repartition(self.buckets, "digest")
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Delete the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def fresh(self, keyed: DataFrame) -> DataFrame:
        """(digest, keep_id) of the batch's texts that the index does not hold.

        The batch's distinct digests are staged: Spark would push the anti-join below the
        aggregation, and a large group's rows would all be shuffled to one task.
        """
        batch = stage(keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "batch-digests")
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, keyed: DataFrame) -> None:
        """Append a batch of (doc_id, digest). The anti-join is staged first: a table cannot be read while appended to."""
        rows = stage(self.fresh(keyed), "fresh-digests")
        self._append(rows)
        discard(rows)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row) of each document; ``row`` tells repeated rows apart."""
    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))


def add_descending(keyed: DataFrame, index: DigestIndex, batches: int) -> None:
    """Feed ranges of ids from the largest down, so that the largest id is stored first."""
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or batches == 1:
        return index.add(keyed)
    edges = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
    for a, b in reversed(list(zip(edges, edges[1:]))):
        if a < b:
            index.add(keyed.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
    return index.add(keyed.filter("doc_id is null"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """Decide every document: doc_id, digest, keep_id, group_size, kept. An index of its own, where none is given, is dropped again."""
    keyed = stage(keyed_rows(docs), "digests")
    given = index is not None
    index = index if given else DigestIndex(docs.sparkSession)
    add_descending(keyed, index, batches)
    # The partial aggregates of a task shrink a large group to one row before the shuffle.
    groups = keyed.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    decided = stage(groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", F.col("last.row").alias("last_row"), "group_size"), "digest-groups")
    if not given:
        index.drop()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("last_row"))
    return spread_join(keyed, decided, ["digest"], "group_size", ["row"]).select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"))


def drop_copies(docs: DataFrame, batches: int = 1) -> DataFrame:
    """The documents that stay, with their columns. Rows that repeat doc_id and text become one."""
    decided = stage(exact_dedup(docs, batches=batches), "decisions")
    dropped = stage(decided.filter(~F.col("kept")).select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")), "dropped")
    name = fresh_name(docs, "digest")
    keyed = docs.withColumn(name, text_digest(F.col("text")))
    same = lambda d: keyed["doc_id"].eqNullSafe(d["doc_id"]) & (keyed[name] == d["digest"])
    # A sort-merge join at every size: it does not turn with the number of copies.
    gone = dropped.filter("not again").hint("merge")
    left = keyed.join(gone, same(gone), "left_anti")
    if dropped.filter("again").isEmpty():
        return left.drop(name)
    return left.dropDuplicates(["doc_id", name]).drop(name)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), batches=2)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

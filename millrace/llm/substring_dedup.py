"""Substring deduplication on a compacted De Bruijn graph of token k-mers.

A window of 13 words is an edge between its first and its last 12 words. Passes:

1. each text lists its anchors: in every window the five-word gram of smallest hash.
   Equal windows have equal anchors, so only anchors that occur in two different
   texts can hold repeated windows (a fifth of the windows' number is shuffled);
2. texts with such anchors list the windows around them as edges: the hashes of the
   nodes at both ends (128 bits together) and their coordinates. Copies of a whole text are
   decided by its digest and stay out of the graph;
3. edges are counted with a fingerprint of the set of places where they occur, and those
   of two documents stay. Two edges are one nonbranching path where a node joins them and
   the places of the second are those of the first moved by one, as every text that
   takes one then takes the other. Walks along source coordinates find the heads, edges
   that no other leads to, and a path is its head and the edges that follow in its source;
4. only heads are joined with their occurrences. An occurrence in a text after the
   source holds the whole path, so its span follows from the path's length;
5. each document drops the words of its spans.

Anchors that are frequent are cut down to two rows a batch before the shuffle, edges
are counted by partial aggregation, and heads meet their occurrences in slices by their count.

Defined cases: a null text has no words; windows are judged on the input, and only a
smaller doc_id takes precedence, so rows that repeat a doc_id do not remove each other;
rows with a null doc_id stay whole and are no source; texts of fewer than 13 words stay
whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import spread_join
from .staging import discard, shuffle_partitions, stage
from .words import WordHashes, shingle_hashes, split_words

#: Words in a window, and in the grams that anchors are chosen from.
WINDOW, GRAM = 13, 5
_WORDS = WordHashes()


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window: the smallest hash among its grams."""
    grams = shingle_hashes(hashes, GRAM, seed=3)
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64)
    low = grams[:n].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(low, grams[k : k + n], out=low)
    return low


#: Words whose hashes are computed together, about: short texts share the cost of a call.
TOGETHER = 1 << 16


def hashed_together(texts: Iterable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of some texts one after another: number of the first text, hashes, and where each text begins, the end last.

    What is computed over all of them is the same inside a text; windows across two texts are left out by the caller.
    """
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(_WORDS.of(split_words(text.as_py())))
        size += len(held[-1])
        if size >= TOGETHER:
            yield first, np.concatenate(held), np.cumsum([0, *map(len, held)])
            first, held, size = k + 1, [], 0
    if held:
        yield first, np.concatenate(held), np.cumsum([0, *map(len, held)])


def members(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the values that are among those wanted; equal neighbours are looked up once."""
    if not len(values) or not len(wanted):
        return np.empty(0, np.int64)
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    wanted = np.sort(wanted)
    found = wanted[np.minimum(np.searchsorted(wanted, values[heads]), len(wanted) - 1)] == values[heads]
    return np.flatnonzero(np.repeat(found, np.diff(np.append(heads, len(values)))))


def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text) to (anchor, th, deal), once for each anchor and text of a batch.

    Rows are dealt by anchor. Of an anchor that a batch holds in several texts only two
    rows are, so that other batches learn of it; it is known to be repeated, and its
    other rows get ``deal`` null and go their own way.
    """
    for batch in batches:
        texts = batch.column(0).to_numpy(zero_copy_only=False)
        th, kept = np.unique(texts, return_index=True)
        found = []
        for _, whole, starts in hashed_together(batch.column(1)[int(k)] for k in kept):
            low = anchors(whole)
            found += [np.unique(low[a : max(a, b - WINDOW + 1)]) for a, b in zip(starts, starts[1:])]
        if not found:
            continue
        anchor, th = np.concatenate(found), np.repeat(th, [len(f) for f in found])
        order = np.argsort(anchor, kind="stable")
        anchor, th = anchor[order].view(np.int64), th[order]
        begins = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.empty(0, np.int64)
        rank = np.arange(len(anchor)) - np.repeat(begins, np.diff(np.append(begins, len(anchor))))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(th), pa.array(anchor, mask=rank >= 2)], ["anchor", "th", "deal"])


#: ``at`` holds the text's number and, in its low bits, the word that the window starts at: as many bits as the longest text needs.
EDGES = "lnode long, rnode long, at long"


def list_edges(word_bits: int):
    """Function for ``mapInArrow``: (number, text, anchors) to the windows whose anchor is among those given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, given = batch.column(0).to_pylist(), batch.column(2)
            for first, whole, starts in hashed_together(batch.column(1)):
                columns: list[list[np.ndarray]] = [[] for _ in range(3)]
                low, nodes = anchors(whole), shingle_hashes(whole, WINDOW - 1, seed=4).view(np.int64)
                for k, (a, b) in enumerate(zip(starts, starts[1:]), first):
                    pos = members(low[a : max(a, b - WINDOW + 1)], given[k].values.to_numpy().view(np.uint64))
                    if not len(pos):
                        continue
                    for c, v in zip(columns, (nodes[a + pos], nodes[a + pos + 1], pos + (numbers[k] << word_bits))):
                        c.append(v)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["lnode", "rnode", "at"])

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def drop_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, later copy, spans) to what is left of each text: words joined by one space."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part, rows = batch.slice(first, 512), []
            for doc_id, text, later, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = split_words(text.as_py())
                n = len(words)
                if later and n >= WINDOW:
                    words = []
                elif spans:
                    edge = np.zeros(n + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["end"]] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                rows.append((doc_id, n, n - len(words), b" ".join(words)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()).cast(pa.string())], schema=_KEPT)


def numbered(texts: DataFrame) -> tuple[DataFrame, int]:
    """Staged ``texts`` (doc_id, th, digest, bytes) with ``number``: 0, 1... in order of doc_id, then th; and the bits of a word's place.

    One count of each range is gathered. A text of n bytes has n / 2 words at most, so numbers and
    places fit into 63 bits unless there are more texts than 2 ** 63 over the words of the longest.
    """
    dealt = texts.repartitionByRange(shuffle_partitions(texts.sparkSession), "doc_id", "th").withColumn("part", F.spark_partition_id())
    dealt = stage(dealt.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "th", "digest"))), "dealt-texts")
    found = dealt.groupBy("part").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")).collect()
    counts = {r.part: r.n for r in found}
    word_bits = int(max((r.bytes for r in found), default=0) // 2 + 1).bit_length()
    if sum(counts.values()) >= 1 << (63 - word_bits):
        raise ValueError(f"more than {1 << (63 - word_bits)} different texts, the longest of 2 ** {word_bits} words")
    before = [sum(n for p, n in counts.items() if p < k) for k in range(max(counts, default=0) + 1)]
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("part") + 1)
    return stage(dealt.select("doc_id", "th", "digest", (start + F.col("row") - 1).alias("number")), "numbered-texts"), word_bits


def repeated_edges(windows: DataFrame, word_bits: int) -> DataFrame:
    """Edges that occur in two texts: first place ``src``, number n and fingerprints of all places and of those one word on."""
    place = lambda by: F.bit_xor(F.xxhash64(F.col("at") + by))
    edges = windows.groupBy("lnode", "rnode").agg(F.min("at").alias("src"), F.max("at").alias("last"), F.count("*").alias("n"), place(0).alias("places"), place(1).alias("onward"))
    return edges.filter(F.shiftright("last", word_bits) > F.shiftright("src", word_bits)).drop("last")


def compacted(edges: DataFrame, word_bits: int) -> DataFrame:
    """Nonbranching paths of repeated edges: nodes of the head, first place ``src``, number n of occurrences and ``length`` in edges.

    Where one edge leads to the next in every place, their first places follow each other.
    So along each source an edge stays on the path of the one a word before it if the node
    and the fingerprints agree, and heads a path of its own otherwise.
    """
    along = Window.partitionBy("text").orderBy("src")
    before = F.lag(F.struct("src", "rnode", "n", "onward")).over(along)
    led = (before["src"] + 1 == F.col("src")) & (before["rnode"] == F.col("lnode")) & (before["n"] == F.col("n")) & (before["onward"] == F.col("places"))
    marked = edges.withColumn("text", F.shiftright("src", word_bits)).withColumn("heads", ~F.coalesce(led, F.lit(False)))
    walked = marked.withColumn("path", F.last(F.when(F.col("heads"), F.col("src")), True).over(along))
    paths = walked.groupBy("text", "path").agg(F.count("*").alias("length"), F.max(F.when(F.col("heads"), F.struct("lnode", "rnode", "n"))).alias("head"))
    return paths.select("head.lnode", "head.rnode", "head.n", F.col("path").alias("src"), "length")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, th, start, end) of words to drop, and the later copies (doc_id, th) of whole texts."""
    keyed = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    copies = stage(keyed.select("doc_id", "th", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("bytes")), "digests")
    # One text of each digest goes on.
    firsts = copies.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.max("bytes").alias("bytes"))
    firsts, word_bits = numbered(firsts.select("digest", "first.*", "bytes"))
    copied = firsts.select("digest", F.col("doc_id").alias("first"))
    later = stage(copies.join(copied, "digest").filter("doc_id > first").select("doc_id", "th").distinct(), "later-copies")

    listed = keyed.select("th", "text").mapInArrow(list_anchors, "anchor long, th long, deal long")
    group = Window.partitionBy("dealt", "alone")
    dealt = listed.select("anchor", "th", F.col("deal").isNull().alias("alone"), F.coalesce("deal", F.xxhash64("anchor", "th")).alias("dealt"))
    repeated = dealt.withColumn("differ", F.col("alone") | (F.min("th").over(group) != F.max("th").over(group))).filter("differ")
    wanted = repeated.groupBy("th").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(wanted.join(firsts.select("doc_id", "th", "number"), "th"), "repeated-anchors")

    held = keyed.join(wanted.hint("merge"), ["doc_id", "th"])
    if not copies.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        held = held.dropDuplicates(["doc_id", "th"])  # a row given twice is no second place
    held = held.select("number", "text", "anchors")
    windows = stage(held.mapInArrow(list_edges(word_bits), EDGES), "edges")
    # A path's source is the first of the texts that hold it; other texts of its doc_id keep theirs.
    sources = firsts.select(F.col("number").alias("src_text"), F.col("doc_id").alias("src_id"))
    paths = compacted(stage(repeated_edges(windows, word_bits), "repeated-edges"), word_bits).withColumn("src_text", F.shiftright("src", word_bits))
    paths = stage(paths.join(sources, "src_text").select("lnode", "rnode", "n", "src_id", "src_text", "length"), "paths")
    discard(copies, wanted)

    met = spread_join(windows, paths, ["lnode", "rnode"], "n", ["at"]).withColumn("number", F.shiftright("at", word_bits)).filter("number > src_text")
    start = F.col("at").bitwiseAND(F.lit((1 << word_bits) - 1)).cast("int")
    spans = stage(met.select("number", "src_id", start.alias("start"), (start + F.col("length") + (WINDOW - 1)).cast("int").alias("end")), "spans")
    discard(windows, paths)
    return spans.join(firsts.select("doc_id", "th", "number"), "number").filter("doc_id > src_id").select("doc_id", "th", "start", "end"), later


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the text that is left, for each row."""
    spans, later = repeated_spans(docs)
    per = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marks = stage(per.join(later.withColumn("later", F.lit(True)), ["doc_id", "th"], "full"), "marks")
    read = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(marks.hint("merge"), ["doc_id", "th"], "left")
    return read.select("doc_id", "text", "later", "spans").mapInArrow(drop_spans, "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, p, list_aggregate(ws[p:p+12], 'string_agg', ' ') AS win FROM w, range(1, greatest(len(ws) - 11, 1)) AS r(p)
), f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM g),
  gone AS (SELECT DISTINCT doc_id, p + k AS q FROM f, range(13) AS o(k) WHERE again),
  kept AS (
  SELECT w.doc_id, string_agg(t.word, ' ' ORDER BY t.q) AS words, count(*) AS n
  FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q) AS t
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.q = t.q) GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence
in the text. A sketch takes the labelled shingles with the smallest values under one
random function and keeps them in text order, so it is sensitive to order as well as
to content. Texts that agree on two sketches or more with a bucket's first member
gather in neighbourhoods, which are compared in blocks of bounded size: the number of
common labelled shingles bounds the similarity of a pair from above, and what passes is
aligned. No pair is emitted but the links found that join two parts, at most one a text.

A neighbourhood of one block is done then. In larger ones each block is compared within
itself, then one text of each part found so far, as long as that joins parts; this makes a
large group of copies one part in a few linear rounds. What is left are pairs of
different parts: texts that share a bucket which holds several parts are compared, in
pairs of blocks that leave out two blocks of one part. Texts at 0.8 share half of their
buckets, so no pair is lost that way, and texts that share boilerplate only meet in
few buckets.

Similarity is common / (n1 + n2 - common), where common is the longest common
subsequence of labelled shingles inside a band. At 0.8 at most a ninth of both texts'
shingles can be out of line, so a band of that width loses nothing.

Words are compared in lower case without marks at either end. Texts of fewer than five
words are one shingle. Classes are the components of links of 0.8 or more.

Defined cases: null, empty and blank texts have no words and are copies of each other;
texts equal up to case, marks and blanks are copies; the smallest doc_id of a class
stays (rows that repeat it are further copies); a null doc_id stays only in a class
without others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .remembered import forget, remembered
from .skew import spread_join
from .staging import discard, fresh_name, stage
from .words import WordHashes, _odd, mixed, shingle_hashes, split_words

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of a text and labelled shingles in each: two texts at 0.8 agree on half of the sketches, and on one at most once in a million.
SKETCHES = 24
PICKS = 3
#: Sketches on which a text agrees with the first of a bucket before they are neighbours.
AGREE = 2
#: Shingles in a block, about; a task holds two blocks.
BLOCK_SHINGLES = 400_000
#: Rounds over one text of each part go on while they leave no more than this share of the parts.
SHRINK = 0.7
_MARKS = re.compile(r"^\W+|\W+$")
_FACTORS = _odd(7, SKETCHES)
_ORDER = _odd(8, PICKS)


def normal_word(word: bytes) -> bytes:
    low = word.decode("utf-8", "replace").lower()
    return (_MARKS.sub("", low) or low).encode()


def labelled_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its occurrence, in text order; all are distinct."""
    if 0 < len(hashes) < SHINGLE:
        return shingle_hashes(hashes, len(hashes))
    s = shingle_hashes(hashes, SHINGLE)
    order = np.argsort(s, kind="stable")
    t = s[order]
    again = np.flatnonzero(t[1:] == t[:-1]) + 1
    if len(again):
        first = np.arange(len(t))
        first[again] = 0
        nth = np.arange(len(t)) - np.maximum.accumulate(first)
        s = s.copy()
        s[order] = mixed(t + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s


def sketches(s: np.ndarray) -> np.ndarray:
    """One key for each sketch of a text's labelled shingles."""
    if not len(s):
        return np.empty(0, np.int64)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, 200_000 // len(s))
    for a in range(0, SKETCHES, step):
        values = mixed(s[None, :] * _FACTORS[a : a + step, None])
        picks = np.argpartition(values, PICKS - 1, axis=1)[:, :PICKS] if len(s) > PICKS else np.tile(np.arange(len(s)), (len(values), 1))
        picked = s[np.sort(picks, axis=1)]
        out[a : a + step] = (picked * _ORDER[: picked.shape[1]]).sum(axis=1, dtype=np.uint64)
    return mixed(out + np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _hashes(text: str | None) -> np.ndarray:
    return remembered("normal words", lambda: WordHashes(normal_word)).of(split_words(text))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, row, hash, text) to those with digest, n and keys instead of the text."""
    for batch in batches:
        found = []
        for text in batch.column(4):
            h = _hashes(text.as_py())
            s = labelled_shingles(h)
            found.append((_digest(h), len(s), sketches(s)))
        types = (pa.binary(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", "key", "row", "hash", "digest", "n", "keys"])


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text) to (digest, sequence) where the text has that digest."""
    for batch in batches:
        rows = []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = _hashes(text.as_py())
            if _digest(h) == digest:
                rows.append((digest, (labelled_shingles(h) >> np.uint64(32)).astype("<u4").tobytes()))
        columns = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["digest", "sequence"])


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sequences by their longest common subsequence inside the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    n = len(a) + len(b)
    near = np.abs(i - j) <= n // 9 + 1
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    return common / (n - common) if n else 1.0


Text = tuple[bytes, bytes, np.ndarray]


def link_blocks(left: list[Text], right: list[Text] | None) -> list[tuple[bytes, bytes]]:
    """Links that join parts, among ``left`` or between ``left`` and ``right``: each as (member, smallest of its part).

    Texts are (name, label, sequence); those of one label are known to be of one part.
    """
    every = left + (right or [])
    names = [d for d, _, _ in every]
    sizes = np.array([len(s) for _, _, s in every])
    values, ids = np.unique(np.concatenate([s for _, _, s in every]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = len(left) if right is not None else 0
    known: dict[bytes, int] = {}
    part = np.array([known.setdefault(label, k) for k, (_, label, _) in enumerate(every)])
    mark = np.zeros(len(values), np.int32)
    for k in range(len(left)):
        after = max(first, k + 1)
        if after >= len(every) or not sizes[k] or (part[after:] == part[k]).all():
            continue
        own = ids[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids[starts[after] :]], starts[after:] - starts[after]) if sizes[after:].all() else np.array([mark[ids[s : s + n]].sum() for s, n in zip(starts[after:], sizes[after:])])
        mark[own] = 0
        bound = common / (sizes[k] + sizes[after:] - common)
        for j in (np.flatnonzero((bound >= SIMILARITY - 1e-9) & (part[after:] != part[k])) + after).tolist():
            if part[j] != part[k] and aligned(every[k][2], every[j][2]) >= SIMILARITY - 1e-9:
                part[part == part[j]] = part[k]
    # A part that holds several labels is joined: each label's first text is linked with the smallest text of the part.
    head: dict[int, bytes] = {}
    for p, name in zip(part.tolist(), names):
        head[p] = min(name, head.get(p, name))
    labels = Counter(int(part[k]) for k in known.values())
    return [(names[k], head[part[k]]) for k in known.values() if names[k] != head[part[k]] and labels[int(part[k])] > 1]


def link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (unit, side, digest, label, sequence) to links (a, b); a unit has one side (0) or two (0, 1) and one unit is held at a time."""
    unit, rows = None, []
    forget()

    def links() -> pa.RecordBatch:
        sides = [[t for side, *t in rows if side == k] for k in (0, 1)]
        found = link_blocks(sides[0], sides[1] or None) if sides[0] else []
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for at, side, digest, label, sequence in zip(*(c.to_pylist() for c in batch.columns)):
            if at != unit:
                if rows:
                    yield links()
                unit, rows = at, []
            rows.append((side, digest, label, np.frombuffer(sequence, "<u4")))
    if rows:
        yield links()


def _links(rows: DataFrame) -> DataFrame:
    """Staged links of (unit, side, digest, label, sequence)."""
    units = rows.select("unit", "side", "digest", "label", "sequence").repartition("unit").sortWithinPartitions("unit", "side")
    return stage(units.mapInArrow(link_units, "a binary, b binary"), "links")


def _blocks(texts: DataFrame) -> DataFrame:
    """(place, blocks) for texts (place, n)."""
    return texts.groupBy("place").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))


def _within_blocks(texts: DataFrame, blocks: DataFrame, held: DataFrame, turn: int) -> DataFrame:
    """Links among the texts (digest, place) of each block; ``turn`` deals them anew."""
    dealt = texts.join(blocks, "place").select("digest", F.concat_ws("/", F.hex("place"), F.pmod(F.xxhash64("digest", F.lit(turn)), F.col("blocks")).cast("string")).alias("unit"))
    return _links(dealt.join(held.hint("merge"), "digest").select("unit", F.lit(0).alias("side"), "digest", F.col("digest").alias("label"), "sequence"))


def _labelled(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with ``label``: the part of each so far."""
    return texts.join(found.withColumnsRenamed({"node": "digest"}), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _between_parts(texts: DataFrame, sketched: DataFrame, held: DataFrame) -> DataFrame:
    """Links between labelled texts (digest, n, label) of different parts that share a bucket."""
    rows = stage(sketched.select("bucket", "digest").join(texts, "digest"), "shared-buckets")
    sizes = rows.groupBy("bucket", "label").agg(F.sum("n").alias("n"))
    # Parts above a block have blocks of their own, the others of a bucket share some.
    named = sizes.withColumn("set", F.when(F.col("n") > BLOCK_SHINGLES, F.hex("label")).otherwise(""))
    sets = named.groupBy("bucket", "set").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count("*").alias("parts"), F.any_value("label").alias("any"))
    sets = stage(sets, "sets")
    other = sets.select("bucket", F.col("set").alias("set2"), F.col("blocks").alias("blocks2"))
    # A set meets every other one, and the shared set itself where it holds several parts.
    pairs = sets.join(other, "bucket").filter((F.col("set") < F.col("set2")) | ((F.col("set") == "") & (F.col("set2") == "") & (F.col("parts") > 1)))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("set") == F.col("set2"), F.col("i")).otherwise(0), F.col("blocks2") - 1)))
    unit = F.concat_ws("/", F.col("bucket").cast("string"), "set", F.col("i").cast("string"), "set2", F.col("j").cast("string"))
    units = stage(pairs.select("bucket", "set", "i", "set2", "j", unit.alias("unit")), "block-pairs")
    sides = units.select("bucket", "set", F.col("i").alias("block"), "unit", F.lit(0).alias("side")).unionAll(units.filter("set != set2 or i != j").select("bucket", F.col("set2").alias("set"), F.col("j").alias("block"), "unit", F.lit(1).alias("side")))
    own = rows.join(named.select("bucket", "label", "set"), ["bucket", "label"]).join(sets.select("bucket", "set", "blocks"), ["bucket", "set"])
    own = own.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    met = own.join(sides, ["bucket", "set", "block"]).select("unit", "side", "digest", "label")
    links = _links(met.join(held.hint("merge"), "digest"))
    discard(rows, sets, units)
    return links


def parts_of(members: DataFrame, sketched: DataFrame, held: DataFrame) -> DataFrame:
    """(node, label) of the texts that links join, for staged members (digest, n, place), their buckets and sequences."""
    blocks = stage(_blocks(members), "places")
    links = _within_blocks(members, blocks, held, 0)
    large = blocks.filter("blocks > 1").select("place")
    if large.isEmpty():
        return components(links)
    texts = stage(members.join(large, "place").select("digest", "n", "place"), "large-places")
    # One text of each part goes on; copies become one part in rounds that shrink by the size of a block.
    # A block's links lead each text to the first of its part, so the texts without one are the firsts.
    rounds, before, turn = [links], texts.count(), 0
    firsts = stage(texts.join(links.select(F.col("a").alias("digest")), "digest", "left_anti"), "firsts")
    while (left := firsts.count()) <= SHRINK * before:
        before, turn = left, turn + 1
        rounds.append(_within_blocks(firsts, _blocks(firsts), held, turn))
        firsts = stage(firsts.join(rounds[-1].select(F.col("a").alias("digest")), "digest", "left_anti"), "firsts")
    labelled = texts.withColumn("label", F.col("digest"))
    for found in rounds:
        step = found.select(F.col("a").alias("label"), F.col("b").alias("beyond"))
        labelled = labelled.join(step, "label", "left").select("digest", "n", F.coalesce("beyond", "label").alias("label"))
    between = _between_parts(stage(labelled, "parts"), sketched, held)
    return components(reduce(DataFrame.unionAll, rounds, between))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, row, hash (of the raw text), digest, class_id, class_size, kept of each row."""
    read = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("hash"), "text")
    rows = stage(read.mapInArrow(sketch_rows, "doc_id long, key long, row long, hash long, digest binary, n long, keys array<long>"), "sketches")
    # One text of each digest goes on; its copies come back in the last join.
    texts = rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct("key", "hash")).alias("of"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    sketched = stage(texts.select("digest", "of", "n", F.explode("keys").alias("bucket")), "buckets")
    heads = stage(sketched.groupBy("bucket").agg(F.min("digest").alias("head"), F.count("*").alias("size")).filter("size > 1"), "heads")
    agree = spread_join(sketched, heads, ["bucket"], "size", ["digest"]).filter(F.col("digest") != F.col("head")).groupBy(F.col("digest").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("n"))
    placed = components(stage(agree.filter(F.col("n") >= AGREE).select("a", "b"), "neighbours"))

    members = sketched.select("digest", "of.key", "of.hash", "n").distinct().join(placed.select(F.col("node").alias("digest"), F.col("label").alias("place")), "digest")
    members = stage(members, "members")
    own = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("hash"), "text")
    # A sort-merge join at every size: it does not turn with the number of members. Ids may repeat, so texts are named by both.
    held = own.join(members.select("key", "hash", "digest").hint("merge"), ["key", "hash"]).select("digest", "text").mapInArrow(sequences, "digest binary, sequence binary")
    held = stage(held.groupBy("digest").agg(F.any_value("sequence").alias("sequence")), "sequences")
    found = parts_of(members.select("digest", "n", "place"), sketched, held)
    discard(heads, members, held)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("stays")
    digests = stage(_labelled(rows.groupBy("digest").agg(F.count("*").alias("rows"), first), found), "digests")
    classes = digests.groupBy("label").agg(F.sum("rows").alias("class_size"), F.min("stays").alias("stays"), F.count("*").alias("digests"))
    classes = stage(classes.select("label", "class_size", "digests", F.col("stays.doc_id").alias("class_id"), F.col("stays.row").alias("stays_row")), "classes")
    decided = stage(spread_join(digests.select("digest", "rows", "label"), classes, ["label"], "digests", ["digest"]).select("digest", "rows", "class_id", "class_size", "stays_row"), "decided")
    out = spread_join(rows.select("doc_id", "key", "row", "hash", "digest"), decided, ["digest"], "rows", ["row"])
    return out.select("doc_id", "key", "row", "hash", "digest", "class_id", "class_size", (F.col("row") == F.col("stays_row")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns. Rows that repeat doc_id and text become one."""
    decided = stage(near_classes(docs).select("key", "hash", "kept"), "near-decisions")
    # Rows of one key and text are alike, so one decision holds for them: at most one of them is kept.
    pairs = stage(decided.groupBy("key", "hash").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")), "near-pairs")
    own_key, own_hash = fresh_name(docs, "key"), fresh_name(docs, "hash")
    gone = pairs.filter(~F.col("stays")).select(F.col("key").alias(own_key), F.col("hash").alias(own_hash))
    hashed = F.xxhash64("text")
    keyed = docs.withColumn(own_key, F.coalesce("doc_id", hashed)).withColumn(own_hash, hashed)
    left = keyed.join(gone.hint("merge"), [own_key, own_hash], "left_anti")
    if not pairs.filter(F.col("stays") & (F.col("rows") > 1)).isEmpty():
        left = left.dropDuplicates([own_key, own_hash])
    return left.select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")

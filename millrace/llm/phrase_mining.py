"""Collocations: phrases that occur more often than their parts would by chance, by suffix sorting.

One pass over the texts emits the suffixes of all pieces, cut to ``max_n`` words,
equal ones of a window of words counted together. They are dealt by language and
first word, as sorted and compressed columns (some bytes a suffix), sorted again in
reverse order of their words' 64-bit hashes, and one stack counts all prefixes: a
prefix of d words is closed where fewer than d words agree with the suffix before.
Parts of a phrase are phrases too, at least as frequent as itself, so joins of the
result with itself give the counts for its score.

A first word that is common in a bounded sample is dealt by its second word too, a
common pair by its third, and so on; the sample decides only where suffixes go. The
count of such a common prefix is the sum of what each task has of it. A task counts
parts of about ``PART_BYTES`` of text; where its share of all words is larger, a second shuffle
deals packed windows to parts.

Hashes are checked: each task compares the words behind equal hashes, and a clash
starts the run again with another seed.

Defined cases: a null text has no words; a null language is ``und``, one with a
language of that name; long texts are read whole, in windows of words; empty texts
and pieces give nothing; repeated rows count each; ties are in order of the phrase;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import discard, shuffle_partitions, stage
from .words import WordHashes, mixed

MAX_N, MIN_COUNT, TOP = 5, 100, 2000
#: Percentage of a phrase's occurrences that must lie within a longer one for the phrase to go.
ABSORBED = 100
#: Words whose suffixes a task holds at a time, and documents in the sample that finds common prefixes.
WINDOW_WORDS, SAMPLE_ROWS = 1 << 20, 2000
#: Bytes of text whose suffixes are counted together, about (four million words).
PART_BYTES = 24 << 20
#: Different words that a task remembers by name (about 100 MB).
NAMED_WORDS = 300_000
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 1 << 21
#: Tasks that rank one language's phrases before its last ranking.
RANK_TASKS = 64
#: Characters that end a piece; blanks that separate words are a space and a tab.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(PIECE_ENDS + bytes(range(65, 91)), b"." * len(PIECE_ENDS) + bytes(range(97, 123)))
SUFFIX_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("packed", pa.binary())])
SUFFIX_SCHEMA = "bucket int, part int, lang string, size long, packed binary"
PREFIX_ARROW = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase_key", pa.binary()), ("f", pa.int64()), ("word", pa.binary())])
PREFIX_SCHEMA = "lang string, words int, phrase_key binary, f long, word binary"


class HashClash(Exception):
    """Two words have one hash."""


class Vocabulary(WordHashes):
    """Hashes of words, and the words back if they are ``named``; 0 is the end of a piece."""

    def __init__(self, seed: int, named: bool = False):
        super().__init__()
        self.seed, self.names = np.uint64(seed * 2 + 1), {} if named else None
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        value = super().__missing__(word)
        if self.seed != 1:
            value = int(mixed(np.array([value], np.uint64) * self.seed)[0])
        value = self[word] = value or 1
        if self.names is not None and self.names.setdefault(value, word) != word:
            raise HashClash(f"{word!r} and {self.names[value]!r}")
        return value

    def of(self, words: list[bytes], still: np.ndarray | None = None) -> np.ndarray:
        """Hashes of words. When the memory is full it is emptied, but for the names of what is ``still`` needed."""
        if len(self) > NAMED_WORDS:
            kept = {h: self.names[h] for h in set(still.tolist()) if h} if self.names is not None else {}
            self.clear()
            self[b"."] = 0
            if self.names is not None:
                self.names = kept
                self.update({w: h for h, w in kept.items()})
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def folded_slices(texts: list[str]) -> Iterator[list[bytes]]:
    """Words of texts in small letters, with ``.`` at the end of each piece; each slice ends between words."""
    data = ".".join(texts).encode("utf-8", "surrogatepass").translate(_FOLD) + b"."
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in (b".", b" ", b"\t")) + 1
            # A word longer than a slice is read whole.
            end = cut or min(x for x in (*(data.find(b, end) + 1 for b in (b".", b" ", b"\t")), len(data)) if x > 0)
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def lang_hash(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, some slices together."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > 4 * SLICE_BYTES or len(held) > 64:
                yield lang, held.pop(lang)
                size.pop(lang)
    yield from held.items()


def suffix_matrix(codes: np.ndarray, max_n: int) -> np.ndarray:
    """One column a word: the word and those after it in its piece, ``max_n`` at most, 0 beyond the end."""
    at = np.flatnonzero(codes[: len(codes) - max_n])
    out = np.zeros((max_n, len(at)), codes.dtype)
    alive = np.ones(len(at), bool)
    for k in range(max_n):
        word = codes[at + k]
        alive &= word != 0
        out[k] = np.where(alive, word, 0)
    return out


def prefix_hashes(lang: str, columns: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Hash of the first word, of the first two, and so on, of each suffix in its language; columns hold words' hashes."""
    value = np.uint64(lang_hash(lang))
    for k, words in enumerate(columns):
        value = mixed(words * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + value)
        yield value


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def dealing_keys(lang: str, columns: Iterable[np.ndarray], common: np.ndarray) -> np.ndarray:
    """What a suffix is dealt by: its first word, and one word more as long as that is a common prefix."""
    key, going = None, None
    for hashes in prefix_hashes(lang, columns):
        key = hashes if key is None else np.where(going, hashes, key)
        here = among(hashes, common)
        going = here if going is None else going & here
        if not going.any():
            break
    return key


def sort_keys(codes: np.ndarray, distinct: int) -> tuple[np.ndarray, ...]:
    """Sort keys of suffixes of small codes (columns), the last one first: several codes in one number where they fit."""
    bits = max(1, int(distinct).bit_length())
    width = 63 // bits
    keys = []
    for first in range(0, len(codes), width):
        key = np.zeros(codes.shape[1], np.int64)
        for column in codes[first : first + width]:
            key = (key << bits) | column
        keys.append(key)
    return tuple(reversed(keys))


def runs_of(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where, in the given order, a row differs from the one before in any column."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


@dataclass
class Suffixes:
    """Suffixes as codes (one column each) of a list of word hashes, code 0 the end; with counts, and the names of first words."""

    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    names: dict[int, bytes]

    def packed(self) -> tuple[int, bytes]:
        """Size and compressed bytes: sorted columns of small codes shrink to a few bytes a suffix."""
        used, local = np.unique(self.codes, return_inverse=True)
        if len(used) == 0 or used[0] != 0:
            used, local = np.insert(used, 0, 0), local + 1
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        columns = np.ascontiguousarray(local.reshape(self.codes.shape).astype(kind))
        firsts = np.unique(columns[0]).astype(np.uint32)
        texts = [self.names[h] for h in self.hashes[used[firsts]].tolist()]
        head = np.array([self.codes.shape[1], len(used), len(firsts)], np.uint32)
        lengths = np.array([len(t) for t in texts], np.uint32)
        data = b"".join((head.tobytes(), self.hashes[used].tobytes(), firsts.tobytes(), lengths.tobytes(), columns.tobytes(), self.counts.astype(np.uint32).tobytes(), *texts))
        return len(data), pa.Codec("zstd", 1).compress(data, asbytes=True)

    @staticmethod
    def unpacked(size: int, data: bytes, max_n: int) -> Suffixes:
        raw = pa.Codec("zstd").decompress(data, size, asbytes=True)
        at = 12

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        rows, words, named = np.frombuffer(raw, np.uint32, 3).tolist()
        hashes, firsts, lengths = take(np.uint64, words), take(np.uint32, named), take(np.uint32, named)
        codes, counts = take(np.uint16 if words < 1 << 16 else np.uint32, rows * max_n).reshape(max_n, rows), take(np.uint32, rows)
        names = {}
        for h, n in zip(hashes[firsts].tolist(), lengths.tolist()):
            names[h] = raw[at : at + n]
            at += n
        return Suffixes(hashes, codes, counts.astype(np.int64), names)


def windowed(lang: str, ids: np.ndarray, max_n: int, common: np.ndarray, names: dict[int, bytes]) -> tuple[Suffixes, np.ndarray]:
    """The different suffixes of a window of words, sorted by dealing key, and their dealing keys."""
    hashes, code = np.unique(np.append(ids, np.uint64(0)), return_inverse=True)
    codes = suffix_matrix(code[:-1].astype(np.int32), max_n)
    key = dealing_keys(lang, (hashes[c] for c in codes), common)
    order = np.lexsort((*sort_keys(codes, len(hashes)), key))
    starts = runs_of(order, key, *codes)
    counts = np.diff(np.append(starts, len(order)))
    picked = order[starts]
    return Suffixes(hashes, codes[:, picked], counts, names), key[picked]


def dealt(found: Suffixes, place: np.ndarray, lang: str, bucket_of) -> Iterator[tuple]:
    """One packed row for each place (a number; rows of one place need not stand together)."""
    order = np.argsort(place, kind="stable")
    ordered = place[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else []
    for first, end in zip(starts, [*starts[1:], len(order)]):
        rows = order[first:end]
        yield (*bucket_of(int(ordered[first])), lang, *Suffixes(found.hashes, found.codes[:, rows], found.counts[rows], found.names).packed())


def suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SUFFIX_ARROW)], schema=SUFFIX_ARROW)


def suffix_windows(batches: Iterator[pa.RecordBatch], seed: int, max_n: int, common: np.ndarray) -> Iterator[tuple[str, Suffixes, np.ndarray]]:
    """(lang, suffixes, dealing keys) of each window of words of (lang, text) rows."""
    vocabulary = Vocabulary(seed, named=True)
    pad = np.zeros(max_n, np.uint64)
    for lang, texts in by_language(batches):
        rest = np.empty(0, np.uint64)
        for words in folded_slices(texts):
            rest = np.concatenate([rest, vocabulary.of(words, rest)])
            while len(rest) > WINDOW_WORDS + max_n:
                # The last words of a window are looked at, and begin the next one.
                if rest[:WINDOW_WORDS].any():
                    yield lang, *windowed(lang, rest[: WINDOW_WORDS + max_n], max_n, common, vocabulary.names)
                rest = rest[WINDOW_WORDS:]
        if rest.any():
            yield lang, *windowed(lang, np.concatenate([rest, pad]), max_n, common, vocabulary.names)


def suffix_emitter(seed: int, max_n: int, common: np.ndarray, buckets: int):
    """Function for ``mapInArrow``: (lang, text) to packed suffixes, one row for each bucket and window of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found, key in suffix_windows(batches, seed, max_n, common):
            yield suffix_batch(list(dealt(found, (key % np.uint64(buckets)).astype(np.int64), lang, lambda k: (k, 0))))

    return run


def part_emitter(max_n: int, buckets: int, parts: int, common: np.ndarray):
    """Function for ``mapInArrow``: packed suffixes to those of the parts of their bucket, a window at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, _, lang, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
                found = Suffixes.unpacked(size, packed, max_n)
                key = dealing_keys(lang, (found.hashes[c] for c in found.codes), common)
                yield suffix_batch(list(dealt(found, (key // np.uint64(buckets) % np.uint64(parts)).astype(np.int64), lang, lambda k, b=bucket: (b, k))))

    return run


def prefix_counter(max_n: int, min_count: int, common: np.ndarray):
    """Function for ``mapInArrow``: packed suffixes sorted by (part, lang) to prefixes and their counts; words 0 is the language's number of words.

    Prefixes below ``min_count`` are left out, but for the common ones, of which other tasks hold a part.
    """

    def counted(lang: str, held: list[Suffixes]) -> Iterator[pa.RecordBatch]:
        names: dict[int, bytes] = {}
        for found in held:
            for h, text in found.names.items():
                if names.setdefault(h, text) != text:
                    raise HashClash(f"{text!r} and {names[h]!r}")
        # One list of words for all; codes keep the order of the hashes, and larger ones come first.
        hashes, place = np.unique(np.concatenate([f.hashes for f in held]), return_inverse=True)
        ends = np.cumsum([0, *(len(f.hashes) for f in held)])
        place = place.astype(np.int32)
        codes = np.empty((max_n, sum(f.codes.shape[1] for f in held)), np.int32)
        counts, at = np.empty(codes.shape[1], np.int64), 0
        for a, b in zip(ends, ends[1:]):
            f = held.pop(0)
            upto = at + f.codes.shape[1]
            codes[:, at:upto], counts[at:upto] = place[a:b][f.codes], f.counts
            at = upto
        # Each word begins one suffix.
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([b""]), pa.array([int(counts.sum())]), pa.array([None], pa.binary())], schema=PREFIX_ARROW)
        order = np.lexsort(sort_keys(codes, len(hashes)))[::-1]
        n = counts[order]
        closed = np.zeros(len(order), bool)
        closed[0] = True
        for depth, prefixes in enumerate(prefix_hashes(lang, (hashes[c[order]] for c in codes)), 1):
            # A prefix of this depth ends where this word, or one before it, is another.
            word = codes[depth - 1][order]
            closed[1:] |= word[1:] != word[:-1]
            heads = np.flatnonzero(closed)
            f = np.add.reduceat(n, heads)
            wanted = (hashes[word[heads]] != 0) & ((f >= min_count) | among(prefixes[heads], common))
            heads, f = order[heads[wanted]], f[wanted]
            if not len(heads):
                continue
            keys = np.ascontiguousarray(hashes[codes[:depth, heads]].T.astype(">u8"))
            offsets = (np.arange(len(heads) + 1) * 8 * depth).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(keys)])
            text = [names[h] for h in hashes[codes[0][heads]].tolist()] if depth == 1 else [None] * len(heads)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(heads), pa.string()), pa.array(np.full(len(heads), depth, np.int32)), packed, pa.array(f), pa.array(text, pa.binary())], schema=PREFIX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for bucket, part, lang, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if held and last != (bucket, part, lang):
                    yield from counted(last[2], held)
                    held = []
                last = (bucket, part, lang)
                held.append(Suffixes.unpacked(size, packed, max_n))
        if held:
            yield from counted(last[2], held)

    return run


def common_prefixes(docs: DataFrame, seed: int, max_n: int, rows: int) -> np.ndarray:
    """Sorted hashes of prefixes that hold more than a quarter of a task's share of a sample's suffixes.

    The list is bounded by the share: at most ``4 * max_n * shuffle partitions`` entries.
    """
    spark = docs.sparkSession
    sample = docs if rows <= SAMPLE_ROWS else docs.sample(SAMPLE_ROWS / rows, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found, _ in suffix_windows(batches, seed, max_n, np.empty(0, np.uint64)):
            for hashes in prefix_hashes(lang, (found.hashes[c] for c in found.codes)):
                # Suffixes alike are counted together, so what a prefix weighs is its different suffixes.
                which, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    counts = stage(sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "prefix-sample")
    total = (counts.agg(F.sum("n")).first()[0] or 0) / max_n
    found = counts.filter(F.col("n") > total / (4 * shuffle_partitions(spark))).select("hash").collect()
    discard(counts)
    return np.sort(np.array([r.hash for r in found], np.int64).view(np.uint64))


def prefix_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Staged (lang, words, phrase_key, f, word) of all phrases of 1 to ``max_n`` words with f of ``min_count`` or more, and (lang, n)."""
    for seed in range(8):
        try:
            return _prefix_counts(docs, seed, max_n, min_count)
        except Exception as e:
            if "HashClash" not in str(e) or seed == 7:
                raise
    raise AssertionError


def _prefix_counts(docs: DataFrame, seed: int, max_n: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    said = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).filter("text is not null and text <> ''")
    rows, size = said.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    common = common_prefixes(said, seed, max_n, rows)
    buckets = shuffle_partitions(spark)
    packed = said.mapInArrow(suffix_emitter(seed, max_n, common, buckets), SUFFIX_SCHEMA).repartitionById(buckets, F.col("bucket"))
    # What a task gets is counted in parts that fit into memory; parts are dealt out by a second shuffle, of packed windows again.
    parts = -(-(size or 0) // (buckets * PART_BYTES))
    if parts > 1:
        packed = packed.mapInArrow(part_emitter(max_n, buckets, parts, common), SUFFIX_SCHEMA).repartition(buckets * parts, "bucket", "part")
    prefixes = packed.sortWithinPartitions("bucket", "part", "lang").mapInArrow(prefix_counter(max_n, min_count, common), PREFIX_SCHEMA)
    whole = prefixes.groupBy("lang", "words", "phrase_key").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))
    found = stage(whole.filter((F.col("f") >= min_count) | (F.col("words") == 0)), "phrases")
    if not found.filter("word <> other").isEmpty():
        raise HashClash("HashClash between words of two tasks")
    return found.filter("words > 0").drop("other"), found.filter("words = 0").select("lang", F.col("f").alias("n"))


def part(key: Column, first: Column | int, words: Column | int) -> Column:
    """Key of so many words of a phrase, from the given one (from 0)."""
    at = first if isinstance(first, Column) else F.lit(first)
    n = words if isinstance(words, Column) else F.lit(words)
    return F.substring(key, at * 8 + 1, n * 8)


def mine_phrases(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` are those of its parts at the cut that scores
    least, and the score is ``floor(1000 * a * n / (l * r))``. Phrases of which ``absorbed`` percent
    lie within a longer phrase are left out.
    """
    found, totals = prefix_counts(docs, max_n, min_count)
    phrases = found.filter("words > 1").select("lang", "words", "phrase_key", F.col("f").alias("a"))
    # Every run of words inside a phrase, with the phrase's count.
    runs = phrases.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))))
    longer = runs.groupBy("lang", part(F.col("phrase_key"), F.col("at"), F.col("size")).alias("phrase_key")).agg(F.max("a").alias("most"))
    kept = phrases.join(longer, ["lang", "phrase_key"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * absorbed, F.lit(True))).drop("most")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": part(F.col("phrase_key"), 0, F.col("k")), "right": part(F.col("phrase_key"), F.col("k"), F.col("words") - F.col("k"))})
    side = lambda key, f: found.select("lang", F.col("phrase_key").alias(key), F.col("f").alias(f))
    sized = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Products of counts are decimals of 38 digits, and the quotient is cut to a whole number.
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))")
    best = sized.groupBy("lang", "phrase_key", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase_key", "words", "a", "n", "cut.*")
    order = [F.desc("score"), F.desc("a")]
    # The first of each part of a language, then of the language, with all that tie; only these get their texts.
    slice_ = F.pmod(F.xxhash64("phrase_key"), F.lit(RANK_TASKS))
    few = best.withColumn("at", F.rank().over(Window.partitionBy("lang", slice_).orderBy(*order))).filter(F.col("at") <= top)
    few = stage(few.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= top).drop("at"), "best-phrases")
    named = few.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("words") - 1))).withColumn("word_key", part(F.col("phrase_key"), F.col("at"), 1))
    words = found.filter("words = 1").select("lang", F.col("phrase_key").alias("word_key"), F.col("word").cast("string").alias("word"))
    spelled = named.join(words, ["lang", "word_key"]).groupBy("lang", "phrase_key", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said"))
    phrase = spelled.withColumn("phrase", F.array_join("said.word", " "))
    ranked = phrase.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  ),
  said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
  grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM said, range(1, 6) t(k) WHERE len(w) >= k),
  f AS (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
  longer AS (
    SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS most
    FROM f, range(2, 5) t(s), range(1, 5) u(i) WHERE s < words AND i + s - 1 <= words GROUP BY ALL
  ),
  kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase) WHERE words > 1 AND coalesce(100 * most < 100 * a, true)),
  cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM kept, range(1, 5) t(k) WHERE k < words),
  scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang
  ),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

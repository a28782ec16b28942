"""BPE encoding and decoding with content-defined chunk reuse.

A window hash of the last 16 bytes, taken at each blank, cuts texts into chunks, so
equal passages give equal chunks wherever they stand. Passes:

1. every document lists the digests of its distinct chunks (staged, no texts);
2. digests that occur in several documents get one owner each; owners encode those
   chunks once, and the encodings are joined to every document that holds them;
3. each document is put together from shared encodings and its own chunks. At every
   join of chunks the words on both sides are encoded together; where that differs
   from the parts, the two chunks are merged and encoded as one, until all agree.

A chunk is encoded word by word through a bounded memory of words when the
tokenizer drops blanks before its merges, since no token then spans a blank; the
library itself encodes each word. Other tokenizers encode chunks whole.

Defined cases: a null text counts as empty and has no tokens; special tokens written
in a text are special, as in the library; repeated rows are encoded each, and rows that
repeat doc_id and text share one list of shared chunks; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .remembered import remembered
from .skew import spread_join
from .staging import discard, stage
from .words import mixed

#: A blank ends a chunk when its window hash is a multiple of this: chunks of so many words, about.
CHUNK_WORDS = 64
#: Words whose encodings a worker remembers; beyond it the memory is emptied.
REMEMBERED = 180_000
#: Words of Latin letters with a full stop or comma at most: their parts are plain to see, so only the merges are left to do.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes, its length last. A cut depends on the 16 bytes before it only."""
    n = len(data)
    if n <= 16:
        return np.array([n] if n else [], np.int64)
    blank = np.flatnonzero(_BLANK[data[:-1]])
    blank = blank[blank >= 15]
    windows = np.ndarray((n - 7,), "<u8", data.data, strides=(1,))
    value = mixed(mixed(windows[blank - 15]) + windows[blank - 7])
    return np.append(blank[value % np.uint64(CHUNK_WORDS) == 0] + 1, n)


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(np.frombuffer(text, np.uint8)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class Codec:
    """A tokenizer of the library with a bounded memory of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.by_word = _drops_blanks(config)
        self.lower = any(s["type"] == "Lowercase" for s in _steps(config))
        self.plain_decode = config["decoder"] is None
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.numbers = [str(i) for i in range(size)]
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.byte_names = _byte_names()
        # Of each word and simple stem: number of ids, decimal ids and token names, each joined by a space.
        self.words: dict[bytes, tuple[int, str, str]] = {}
        self.stems: dict[str, tuple[int, str, str]] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def strings(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def _stem(self, stem: str) -> tuple[int, str, str]:
        """A run of letters as the merges see it, or one mark: the library's merges over its bytes."""
        if stem not in self.stems:
            tokens = self.tokenizer.model.tokenize(stem if stem.isascii() else "".join([self.byte_names[b] for b in stem.encode()]))
            self.stems[stem] = self.strings([t.id for t in tokens])
        return self.stems[stem]

    def learn(self, texts: list[bytes]) -> None:
        """Remember the words of these chunks."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.stems.clear()
        other = []
        for word in {w for t in texts for w in t.split()} - self.words.keys():
            if m := _SIMPLE.fullmatch(text := word.decode()):
                found = self._stem(m[1].lower() if self.lower else m[1])
                if m[2]:
                    mark = self._stem(m[2])
                    found = (found[0] + mark[0], f"{found[1]} {mark[1]}", f"{found[2]} {mark[2]}")
                self.words[word] = found
            else:
                other.append(text)
        for word, ids in zip(other, self._whole(other)):
            self.words[word.encode()] = self.strings(ids)

    def encode_strings(self, chunk: bytes) -> tuple[int, str, str]:
        """Number of ids, decimal ids and token names of a chunk whose words are learnt."""
        if not self.by_word:
            return self.strings(self._whole([chunk.decode()])[0])
        words = self.words
        found = [f for w in chunk.split() if (f := words[w])[0]]
        if not found:
            return 0, "", ""
        n, ids, names = zip(*found)
        return sum(n), " ".join(ids), " ".join(names)

    def disagreements(self, joins: list[tuple[bytes, bytes]]) -> list[int]:
        """Joins of a left and right chunk where encoding across differs from the parts."""
        edges = [_edge(a, b) for a, b in joins]
        across = self._whole([(x + y).decode() for x, y in edges])
        if self.by_word:
            parts = [self.encode_strings(x + b" " + y)[1] for x, y in edges]
        else:
            each = self._whole([z.decode() for e in edges for z in e])
            parts = [self.strings(each[2 * k] + each[2 * k + 1])[1] for k in range(len(edges))]
        return [k for k, (p, q) in enumerate(zip(across, parts)) if self.strings(p)[1] != q]

    def decode(self, ids_text: str, names_text: str) -> str:
        """What the library decodes the ids to; without a decoder that is the names, joined."""
        if self.plain_decode:
            return names_text
        return self.tokenizer.decode([int(i) for i in ids_text.split()], skip_special_tokens=False)


def _byte_names() -> list[str]:
    """Letter that byte-level tokenizers write for each byte: itself if it prints, else the next unused one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _steps(config: dict) -> list[dict]:
    """Steps of a tokenizer's normalizer."""
    normal = config["normalizer"] or {"type": "Sequence", "normalizers": []}
    return normal.get("normalizers", [normal])


def _drops_blanks(config: dict) -> bool:
    """Whether words encode alone as they do in a text: blanks are removed before the merges and no step looks past one."""
    steps = _steps(config)
    split = config["pre_tokenizer"] or {}
    split = split.get("pretokenizers", [split])[0]
    pattern = split.get("pattern", {}).get("Regex", "")
    return (
        all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in pattern
        and " " not in pattern
        and config["post_processor"] is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
    )


def _edge(left: bytes, right: bytes) -> tuple[bytes, bytes]:
    """Last word of the left chunk and first word of the right one, each with the blanks between."""
    word = left.rsplit(None, 1)
    tail = left[len(left.rstrip()) - len(word[-1].rstrip()) :] if word else left
    word = right.split(None, 1)
    head = right[: len(right) - len(right.lstrip()) + len(word[0])] if word else right
    return tail, head


def codec(path: str) -> Codec:
    """The worker's codec for a file."""
    return remembered(("codec", path), lambda: Codec(path))


def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, digest) of its distinct chunks."""
    for batch in batches:
        keys, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_buffer()
            own = {digest(c) for c in chunks(text.to_pybytes())} if text is not None else set()
            keys += [key] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "digest"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) to those with the text compressed, which halves what the joins by key shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [press.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], ["doc_id", "key", "packed"])


def encode_owned(path: str, width: str):
    """Function for ``mapInArrow``: (packed text, owned digests) to (digest, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, press = codec(path), zstandard.ZstdDecompressor()
        for batch in batches:
            owned: dict[bytes, bytes] = {}
            for packed, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                wanted = set(wanted)
                owned.update((d, c) for c in chunks(press.decompress(packed.as_buffer())) if (d := digest(c)) in wanted)
            if tool.by_word:
                tool.learn(list(owned.values()))
            ids = [np.array(tool.encode_strings(c)[1].split(), width).tobytes() for c in owned.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(owned), pa.binary()), pa.array(ids, pa.binary())], ["digest", "ids"])

    return run


def assemble(path: str, width: str):
    """Function for ``mapInArrow``: (doc_id, packed text, shared encodings) to the result of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, press = codec(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                yield _assembled(tool, press, width, batch.slice(first, 256))

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _assembled(tool: Codec, press: zstandard.ZstdDecompressor, width: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [chunks(press.decompress(t.as_buffer())) if t.is_valid else [] for t in batch.column(1)]
    shared = [{s["digest"]: s["ids"] for s in row or ()} for row in batch.column(2).to_pylist()]
    known: dict[bytes, tuple[int, str, str]] = {}
    own, edge_words = [], []
    for parts, given in zip(texts, shared):
        for c in parts:
            if c not in known:
                if (ids := given.get(digest(c)) if given else None) is not None:
                    known[c] = tool.strings(np.frombuffer(ids, width).tolist())
                else:
                    known[c] = (0, "", "")
                    own.append(c)
        edge_words += [w for a, b in zip(parts, parts[1:]) for w in _edge(a, b)]
    if tool.by_word:
        tool.learn(own + edge_words)
    for c in own:
        known[c] = tool.encode_strings(c)
    todo = range(len(texts))
    while todo:
        joins = [(k, j) for k in todo for j in range(len(texts[k]) - 1)]
        wrong = {joins[i] for i in tool.disagreements([(texts[k][j], texts[k][j + 1]) for k, j in joins])}
        todo = sorted({k for k, _ in wrong})
        for k in todo:
            merged: list[bytes] = []
            for j, c in enumerate(texts[k]):
                if (k, j - 1) in wrong:
                    merged[-1] += c
                else:
                    merged.append(c)
            texts[k] = merged
            for c in merged:
                if c not in known:
                    known[c] = tool.strings(tool._whole([c.decode()])[0])
    rows = []
    for doc_id, parts in zip(batch.column(0).to_pylist(), texts):
        found = [f for c in parts if (f := known[c])[0]]
        ids = " ".join([f[1] for f in found])
        text = tool.decode(ids, " ".join([f[2] for f in found]))
        rows.append((doc_id, sum(f[0] for f in found), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    path = path or default_tokenizer()
    width = "<u2" if len(codec(path).names) <= 1 << 16 else "<u4"
    # Rows that repeat doc_id and text share a key and what is joined by it; other rows differ in it.
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    listed = stage(keyed.filter("text is not null").select("key", "text").mapInArrow(list_chunks, "key long, digest binary"), "chunks")
    uses = listed.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("owner"), F.max("key").alias("last"))
    shared = stage(uses.filter("owner < last").select("digest", "owner", "n"), "shared-chunks")
    # Repeated rows list a chunk once each; the slices of spread_join go by key, so equal entries meet and one is left.
    given = stage(spread_join(listed, shared, ["digest"], "n", ["key"]).groupBy("key", "digest").agg(F.first("n").alias("n")), "shared-uses")
    discard(listed)
    owned = shared.groupBy("owner").agg(F.collect_list("digest").alias("owned"))
    # Sort-merge joins at every size: packing and encoding in one stage would take two Python workers a task, which Spark keeps.
    packed = keyed.mapInArrow(pack, "doc_id long, key long, packed binary")
    held = packed.filter("packed is not null").join(owned.hint("merge"), F.col("key") == F.col("owner")).select("packed", "owned")
    once = held.mapInArrow(encode_owned(path, width), "digest binary, ids binary")
    once = once.groupBy("digest").agg(F.any_value("ids").alias("ids")).join(given.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    once = stage(once, "shared-encodings")
    given = spread_join(given.select("key", "digest"), once, ["digest"], "n", ["key"]).groupBy("key").agg(F.collect_list(F.struct("digest", "ids")).alias("given"))
    whole = packed.join(given.hint("merge"), "key", "left").select("doc_id", "packed", "given")
    discard(shared)
    return whole.mapInArrow(assemble(path, width), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

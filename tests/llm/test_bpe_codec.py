import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe_codec as B
from tests.llm.helpers import EDGES, edges, empty

HARD = ["a b ́x İstanbul ΣΑΣ <|endoftext|> hello<|startoftext|>x it's we'll 12ab", " x  \n\n y\t", "\U0001f600\U0001f600 é ẛ̣ ﬁ 中文字 ŉ <|EndOfText|> ' s 's", "  nbsp　wide", "ÀB,C. D,, ab."]


def expected(text, path=None):
    tool = B.codec(path or B.default_tokenizer()).tokenizer
    ids = tool.encode(text or "", add_special_tokens=False).ids
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tool.decode(ids, skip_special_tokens=False)))


def test_chunks_are_content_defined():
    shared = "".join(f"word{k * 7919 % 1000} " for k in range(2000)).encode()
    a, b = B.chunks(b"one " + shared), B.chunks(b"quite another start " + shared)
    assert b"".join(a) == b"one " + shared and len(a) > 5
    assert a[1:] == b[-len(a) + 1 :]


def test_edges_match_the_library(spark):
    shared = " ".join(f"passage{k * 31 % 97}" for k in range(400))
    rows = [*EDGES, *((100 + k, t, "en", "a", 0, "k") for k, t in enumerate(HARD)), (200, "intro " + shared, "", "", 0, ""), (201, "other intro here " + shared, "", "", 0, "")]
    table = spark.createDataFrame(rows, edges(spark).schema)
    found = sorted((tuple(r) for r in B.encode_documents(table).collect()), key=str)
    assert found == sorted(((d, *expected(t)) for d, t, *_ in rows), key=str)
    assert B.encode_documents(empty(spark)).count() == 0


def test_a_tokenizer_that_keeps_blanks_is_repaired_at_chunk_joins(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not B.codec(path).by_word
    text = "Some words,  with   blanks\n\n and more of them. " * 60
    row = B.encode_documents(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, row)) == [(1, *expected(text, path)), (2, *expected("x " + text, path))]


@pytest.mark.parametrize("left, right, edge", [(b"a bc ", b" de f", (b"bc ", b" de")), (b"ab", b"c", (b"ab", b"c")), (b"  ", b"c d", (b"  ", b"c"))])
def test_edge_words(left, right, edge):
    assert B._edge(left, right) == edge


def test_repeated_rows_are_encoded_in_linear_time(spark):
    passage = " ".join(f"passage{k * 31 % 97}" for k in range(300))
    rows = spark.createDataFrame([(1, passage)], "doc_id long, text string").crossJoin(spark.range(20_000).select(F.lit(0).alias("n"))).select("doc_id", "text")
    table = rows.unionByName(spark.createDataFrame([(2, passage), (None, passage), (None, passage)], rows.schema))
    began = time.monotonic()
    found = {(r.doc_id, *r[1:4]): r.n for r in B.encode_documents(table).groupBy("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").agg(F.count("*").alias("n")).collect()}
    assert found == {(1, *expected(passage)): 20_000, (2, *expected(passage)): 1, (None, *expected(passage)): 2}
    assert time.monotonic() - began < 120


def test_cased_tokenizers_keep_case(tmp_path):
    config = json.loads(B.codec(B.default_tokenizer()).tokenizer.to_str())
    steps = config["normalizer"]["normalizers"]
    config["normalizer"]["normalizers"] = [s for s in steps if s["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(config))
    tool = B.codec(str(path))
    assert tool.by_word and len(steps) > len(config["normalizer"]["normalizers"])
    tool.learn([b"Hello WORLD, abc."])
    assert tool.encode_strings(b"Hello WORLD, abc.")[1] == " ".join(map(str, tool.tokenizer.encode("Hello WORLD, abc.", add_special_tokens=False).ids))

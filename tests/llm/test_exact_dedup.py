import hashlib
from collections import defaultdict

from millrace.llm.exact_dedup import DigestIndex, drop_copies, exact_dedup, keyed_rows
from tests.llm.helpers import EDGES, edges, empty


def test_edges_match_brute_force(spark):
    groups = defaultdict(list)
    for doc_id, text, *_ in EDGES:
        groups[text or ""].append(doc_id)
    rows = exact_dedup(edges(spark, "digest"), batches=3).collect()
    assert len(rows) == len(EDGES)
    by = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest, ids in by.items():
        kept = [r.doc_id for r in rows if bytes(r.digest) == digest and r.kept]
        assert kept == [max((i for i in ids if i is not None), default=None)]


def test_a_later_batch_is_checked_against_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    index.add(keyed_rows(spark.createDataFrame([(9, "a"), (2, "b")], "doc_id long, text string")))
    decided = exact_dedup(spark.createDataFrame([(10, "a"), (11, "c")], "doc_id long, text string"), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in decided.collect()} == {(10, 9, False), (11, 11, True)}
    assert index.read().count() == 3


def test_drop_copies_keeps_columns_and_one_row_of_each_text(spark):
    left = drop_copies(edges(spark))
    assert left.columns == edges(spark).columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in EDGES})


def test_empty(spark):
    assert exact_dedup(empty(spark), batches=2).count() == 0

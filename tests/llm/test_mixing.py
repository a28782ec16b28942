import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.mixing import BLOCK_WORDS, _sized, apply_mix, feistel, mix, targets
from tests.llm.helpers import EDGES, edges, empty
from tests.conftest import SF


def reshared(sizes):
    """Targets by repeated sharing, as the rule is told."""
    w = [float((1, 2, 3)[k % 3]) for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[k] for k in free)
        over = {k for k in free if left * w[k] / total > 3 * sizes[k]}
        if not over:
            for k in free:
                out[k] = left * w[k] / total
            break
        for k in over:
            out[k] = 3.0 * sizes[k]
        left -= sum(out[k] for k in over)
        free -= over
    return out


@given(st.lists(st.integers(0, 10_000), max_size=12))
@settings(max_examples=300)
def test_targets(sizes):
    assert targets(sizes) == pytest.approx(reshared(sizes))


@given(st.integers(1, 3000), st.integers(0, 1 << 80))
@settings(max_examples=60)
def test_permutations(n, key):
    assert sorted(feistel(np.arange(n), n, key)) == list(range(n))


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, mix(_sized(docs)).select("doc_id", "size", "source", "target", "taken").collect()))
    two = sorted(map(tuple, mix(_sized(docs.repartition(5))).select("doc_id", "size", "source", "target", "taken").collect()))
    assert one == two and len(one) == docs.count()
    by = {}
    for _, size, source, target, taken in one:
        assert 0 <= taken <= 3 * size
        total, goal = by.get(source, (0, target))
        by[source] = total + taken, goal
    assert all(abs(total - goal) <= BLOCK_WORDS for total, goal in by.values())


def test_edges(spark):
    rows = mix(_sized(edges(spark, "taken"))).collect()
    assert len(rows) == len(EDGES) and all(r.taken <= 3 * r["size"] for r in rows)
    assert mix(_sized(empty(spark))).count() == 0
    mixed = apply_mix(edges(spark, "copies"))
    assert mixed.columns == edges(spark, "copies").columns and mixed.count() > 0


def test_rows_without_ids_are_dealt(spark, monkeypatch):
    import millrace.llm.mixing as M

    monkeypatch.setattr(M, "CHUNK_ROWS", 50)
    docs = spark.range(600).selectExpr("CAST(NULL AS long) AS doc_id", "concat('s', id % 2) AS source", "repeat('w ', CAST(id % 37 AS int)) AS text", "id")
    taken = mix(_sized(docs, M.F.xxhash64("id").alias("hash"))).collect()
    assert len(taken) == 600 and len({r.chunk for r in taken}) > 6
    for source in ("s0", "s1"):
        own = [r for r in taken if r.source == source]
        spans = sorted((r.start, r["size"]) for r in own if r["size"])
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= BLOCK_WORDS

import numpy as np
import pytest

from millrace.llm import ann_search as A
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")


def brute(ids, x, q, k):
    score = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 100)
    monkeypatch.setattr(A, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in A.search(table, "vec_id % 20 = 0").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        best = brute(np.arange(1500), x, q, 20)
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:]))
        hits += len({v for _, v, _ in got} & {v for v, _ in best})
    assert hits >= 0.9 * 75 * 20


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [NAN, 1.0]), (7, [INF, 1.0]), (20, [-3.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, list string")
    found = sorted(map(tuple, A.search(table, "vec_id % 20 = 0").collect()))
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (0, 4, 20, -3.0), (20, 1, 2, -1.0), (20, 2, 2, -1.0), (20, 3, 0, -3.0), (20, 4, 1, -3.0)]
    assert A.search(table.limit(0), "true").count() == 0


def test_small_tables_are_searched_whole(spark):
    rows = A.op1_ann_search(spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    best = {(int(ids[q]), k + 1): v for q in np.flatnonzero(ids % 20 == 0) for k, v in enumerate(brute(ids, x, q, 20))}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows} == best


@pytest.mark.parametrize("kind, scales", [("float", (1e-30, 1.0, 1e20, 1e38)), ("double", (1e-30, 1.0, 1e20, 1e38)), ("double", (1e-150, 1.0, 1e150))])
@pytest.mark.parametrize("few", [True, False])
def test_any_finite_scale(spark, monkeypatch, kind, scales, few):
    """Vectors of very different sizes, or one that is much larger than all others: every query is answered."""
    rng = np.random.default_rng(3)
    n = 900
    x = (rng.standard_normal((10, 16))[rng.integers(0, 10, n)] + 0.4 * rng.standard_normal((n, 16))) / 10
    x *= (np.where(np.arange(n) == 77, scales[-1], 1.0) if few else np.array(scales)[rng.integers(0, len(scales), n)])[:, None]
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    for rows in (4096, 100):
        monkeypatch.setattr(A, "LIST_ROWS", rows)
        found = {}
        for r in A.search(table, "vec_id % 20 = 0").collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert len(found) == 45 and all(sorted(f)[k][0] == k + 1 for f in found.values() for k in range(20))
        with np.errstate(over="ignore", invalid="ignore"):
            hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in brute(np.arange(n), x, q, 20)}) for q in found)
        assert hits >= 0.9 * 45 * 20

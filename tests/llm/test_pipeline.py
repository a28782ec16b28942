import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    extra = spark.createDataFrame([(-1, "12 %%", "en", "src1", 5), (-2, docs.first().text, "en", "src1", 9)], docs.schema)
    from millrace.llm.staging import stage

    found = docs.unionByName(extra)
    columns, counts = found.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        found = stage(step(spark, found, SF), name)
        assert found.columns == columns, name
        counts.append(Counter(r.doc_id for r in found.select("doc_id").collect()))
    language, exact, near, mixed = counts
    assert language[-1] == 0 and set(exact) <= set(language) and exact[-2] == 0
    assert set(near) <= set(exact) and max(near.values()) == 1
    assert set(mixed) <= set(near) and max(mixed.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, found, SF)
    assert Counter(r.doc_id for r in last.collect()) == mixed


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "encode"]


def fixture(spark):
    """Documents, copies, near copies, junk, nulls, repeated ids and rows, and a source of few words."""
    rng = random.Random(3)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    text = {d: t for d, t, *_ in docs}
    long = [d for d in text if text[d] and 60 < len(text[d].split()) < 400][:8]
    rows = list(docs)
    rows += [(1000 + k, text[d], "en", f"src{k % 3}", 1) for k, d in enumerate(long[:3])]
    for k, d in enumerate(long[3:6]):
        words = text[d].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((2000 + k, " ".join(words), "en", None if k else "few", 1))
    rows += [(3000, None, "en", "src1", 0), (3001, "", None, "src1", 0), (3002, "12 34 %%", "fr", None, 0), (None, text[long[6]] + " with an end of its own", "en", "few", 1), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (docs[0][0], text[long[7]] + " under another id and with further words here", "en", "src2", 1)]
    return rows


def brute_language(rows, spark, schema):
    from millrace.llm import language_id as L
    from tests.llm.test_language_id import brute

    told = brute([(k, None, r[3], r[1]) for k, r in enumerate(rows)], L.sample_rows(spark.createDataFrame(rows, schema), "lang"))
    return [r for k, r in enumerate(rows) if told[k][2]]


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def brute_exact(rows):
    best = {}
    for r in rows:
        t = r[1] or ""
        if t not in best or key(r[0]) > key(best[t][0]):
            best[t] = r
    return list(best.values())


def brute_near(rows):
    from millrace.llm.near_dedup import SIMILARITY, _hashes, labelled_shingles
    from tests.llm.test_near_dedup import classes, similarity

    seq = [labelled_shingles(_hashes(r[1])) for r in rows]
    close = lambda a, b: (not len(a) and not len(b)) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(np.intersect1d(a, b)) > 0 and similarity(a, b) >= SIMILARITY - 1e-9)
    label = classes([(i, j) for i, j in combinations(range(len(rows)), 2) if close(seq[i], seq[j])], len(rows))
    best = {}
    for r, c in zip(rows, label):
        if c not in best or (r[0] is None, r[0] or 0) < (best[c][0] is None, best[c][0] or 0):
            best[c] = r
    return list(best.values())


def brute_mix(rows):
    """Copies of each row by the documented order of blocks and slots, one slot at a time."""
    from millrace.llm import mixing as M

    size = lambda r: len((r[1] or "").encode().split())
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = [sorted((r for r in rows if r[3] == s), key=lambda r: (key(r[0]), size(r))) for s in names]
    totals = [sum(map(size, o)) for o in own]
    out = Counter()
    for src, (docs, n, target) in enumerate(zip(own, totals, M.targets(totals))):
        blocks = -(-n // M.BLOCK_WORDS)
        slots = min(M.MAX_REPEATS * blocks, round(target * blocks / n)) if n else 0
        times = Counter(int(M.feistel(np.array([j % blocks]), blocks, (M.SEED << 64) | (src << 8) | (j // blocks))[0]) for j in range(slots))
        start, placed = 0, []
        for r in docs:
            words = [times[w // M.BLOCK_WORDS] for w in range(start, start + size(r))]
            placed.append((size(r), start, r, sum(words) / len(words) if words else 0.0))
            start += size(r)
        total = 0.5
        for n_words, _, r, reads in sorted(placed, key=lambda p: (p[0], p[1], key(p[2][0]))):
            before, total = total, total + reads
            out[r] += int(total) - int(before) if n_words else 1
    return +out


def test_run_matches_brute_force(spark, tmp_path):
    from tests.llm.test_bpe_codec import expected

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = fixture(spark)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    from millrace.llm.staging import stage

    want = [Counter(rows)]
    for name, brute in (("language", lambda r: brute_language(r, spark, schema)), ("exact", brute_exact), ("near", brute_near)):
        want.append(Counter(brute(list(want[-1].elements()))))
        found = stage(steps[name](spark, found, str(tmp_path)), name)
        assert Counter(map(tuple, found.collect())) == want[-1], name
        assert 0 < want[-1].total() < want[-2].total()
    mixed = brute_mix(list(want[-1].elements()))
    assert Counter(map(tuple, steps["mix"](spark, found, str(tmp_path)).collect())) == mixed and max(mixed.values()) > 1
    result = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert result == Counter((r[0], *expected(r[1])) for r in mixed.elements())


def test_stages_over_empty_tables_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    names = ("__hash", "__key", "__digest", "__copies", "__slice", "host", "salt", "src", "copies", "digest", "key", "row", "label")
    extra = docs.withColumns({n: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for n in names})
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(0), "").count() == 0, name
        out = step(spark, extra, "")
        assert out.columns == extra.columns and out.filter(" or ".join(f"`{n}` != concat('own ', doc_id)" for n in names)).count() == 0 < out.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, "").count() == 12

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id as L
from millrace.llm.language_id import drop_unknown, identify, op10_language_id, op10_page_language, page_rows
from tests.conftest import SF
from tests.llm.helpers import edges, empty


def test_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "qzx wvk jjqx zzkw xqj vvw kkq zxw qqz", None, None), (-2, "12 34 %%", "en", "src1"), (-3, None, "fr", None), (-4, "", "fr", "src1")], "doc_id long, text string, lang string, source string")
    table = docs.select("doc_id", "text", "lang", "source").unionByName(odd)
    blind = table.withColumn("declared", F.lit(None).cast("string"))
    found = {r.doc_id: r for r in identify(blind, declared="declared", carry=["lang"]).collect()}
    real = [r for r in found.values() if r.doc_id >= 0]
    assert sum(r.language == r.lang for r in real) >= 0.98 * len(real)
    assert all(r.kept for r in real) and not any(found[k].kept for k in (-1, -2, -3, -4))
    left = drop_unknown(table)
    assert left.columns == table.columns and left.filter("doc_id < 0").count() == 0


def test_host_priors_decide_where_the_text_does_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hosted = docs.withColumn("host", F.concat("lang", F.lit(".example.org")))
    short = spark.createDataFrame([(-1, "la", None, "fr.example.org"), (-2, "la", None, "es.example.org")], hosted.schema)
    found = {r.doc_id: r.language for r in identify(hosted.unionByName(short), declared=None, host="host").filter("doc_id < 0").collect()}
    assert found == {-1: "fr", -2: "es"}


def test_edges(spark):
    rows = identify(edges(spark, "host")).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert identify(empty(spark)).count() == 0
    assert drop_unknown(edges(spark, "host")).columns == edges(spark, "host").columns


def test_label_is_no_evidence_of_its_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(-k, "la", lang, "src1", 2) for k, lang in enumerate(("en", "fr", "es"), 1)], docs.schema)
    docs.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_language_id(spark, str(tmp_path)).filter("doc_id < 0").collect()
    assert len(found) == 3 and len({(r.language, round(r.confidence, 9)) for r in found}) == 1


def test_evidence_of_pages(spark):
    pages = [
        (1, "https://u@Www.Example.FR:80/a?b=//c.de", "<!DOCTYPE html><!-- <p>no --><HTML class=x lang='fr-CA'><script>var t='</p>no'</script><p>&eacute;t&eacute; a<b>b</b>"),
        (2, "//10.1.2.3", '<html data-lang="de"><p>x'),
        (3, None, None),
    ]
    rows = {r.doc_id: r for r in page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [(rows[k].declared, rows[k].host) for k in (1, 2, 3)] == [("fr", "www.example.fr"), (None, "10.1.2.3"), (None, None)]
    assert rows[1].text.split() == ["été", "a", "b"] and rows[3].text is None


def test_pages_are_identified(spark):
    rows = op10_page_language(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(rows) == pages.count() and all(r.declared_language and "." in r.page_host for r in rows)
    assert sum(r.language == r.declared_language for r in rows) >= 0.95 * len(rows)


def brute(rows, sample):
    """Decisions for (doc_id, declared, host, text) by the module's docstring, one row at a time."""
    names, table = L.fit(sample)
    n, scored = len(names), []
    for doc_id, declared, host, text in rows:
        low = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalpha() or b >= 128 else 32 for b in (text or "").encode())
        grams = [low[k : k + 3] for k in range(len(low) - 2) if low[k : k + 3].count(b" ") <= 1]
        at = [((g[0] * 0x9E3779B1 ^ (g[1] * 0x85EBCA6B & 0xFFFFFFFF) ^ (g[2] * 0xC2B2AE35 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 16 for g in grams]
        logs = table.astype(float)[:, at].sum(1) * min(1.0, L.EFFECTIVE_GRAMS / max(1, len(grams)))
        p = np.exp(logs[:n] - logs[:n].max())
        scored.append((doc_id, declared, host and host.lower(), len(grams), logs, p / p.sum() if grams else np.zeros(n)))
    suffix = lambda host: None if host is None or "." not in host or host.rsplit(".", 1)[1][:1] in "0123456789" else host.rsplit(".", 1)[1]
    total = lambda same: sum((s[5] for s in scored if same(s)), np.zeros(n))
    smooth = lambda own, parent: (own + L.SMOOTHING * parent) / (own.sum() + L.SMOOTHING)
    whole = total(lambda s: True)
    out = {}
    for doc_id, declared, host, grams, logs, _ in scored:
        middle = smooth(total(lambda s: suffix(s[2]) == suffix(host)), (whole + 1) / (whole.sum() + n))
        score = logs[:n] + np.log(smooth(total(lambda s: s[2] == host), middle))
        if declared is not None and any(s[1] == declared and s[3] for s in scored):
            score = score + np.log((total(lambda s: s[1] == declared) + 0.5) / (np.maximum(whole, 1e-9) + 1))
        p = np.exp(score - score.max())
        p /= p.sum()
        out[doc_id] = (names[int(p.argmax())], round(float(p.max()), 5), bool(grams) and logs[:n].max() >= logs[n] + L.UNKNOWN_PRIOR)
    return out


def test_evidence_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    pages = page_rows(spark.read.parquet(f"{SF}/pages.parquet")).limit(40)
    mixed = docs.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'fr' WHEN doc_id % 3 = 1 THEN 'xx' END AS declared", "CASE WHEN doc_id % 4 > 0 THEN concat('H', doc_id % 5, if(doc_id % 2 = 0, '.Org', '.1')) END AS host", "text")
    mixed = mixed.unionByName(pages.withColumn("doc_id", -1 - F.col("doc_id"))).unionByName(spark.createDataFrame([(1000, "fr", "h1.org", None), (1001, None, None, "xq zz"), (1002, "fr", "a.fr", "la")], mixed.schema))
    rows = [tuple(r) for r in mixed.collect()]
    want = brute(rows, L.sample_rows(docs, "lang"))
    found = {r.doc_id: (r.language, round(r.confidence, 5), r.kept) for r in identify(mixed, declared="declared", host="host", labelled=docs).collect()}
    assert len(want) == len(rows) and found.keys() == want.keys()
    for k, (language, confidence, kept) in want.items():
        assert found[k][0] == language and found[k][2] == kept and found[k][1] == pytest.approx(confidence, abs=2e-4), k


def test_ids_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    many = docs.crossJoin(spark.range(20).withColumnRenamed("id", "n")).select("doc_id", F.concat("text", F.lit(" "), F.col("n").cast("string")).alias("text"), "lang", "source")
    with_ids = {r.language: r.n for r in identify(many).filter("kept").groupBy("language").agg(F.count("*").alias("n")).collect()}
    for one in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        found = {r.language: r.n for r in identify(many.withColumn("doc_id", one)).filter("kept").groupBy("language").agg(F.count("*").alias("n")).collect()}
        assert found == with_ids and len(found) > 2
    junk = spark.createDataFrame([(None, "12 34 %%", "en", "src1"), (None, None, "en", None)], docs.schema)
    assert drop_unknown(docs.unionByName(junk)).filter("doc_id is null").count() == 0


def test_sample_is_bounded_and_columns_may_clash(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    most = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert sorted(L.sample_rows(docs, "lang")) == sorted(most)
    names = docs.withColumns({"host": F.col("source"), "grams": F.lit(1), "row": F.lit("r"), "__hash": F.lit(2)})
    found = identify(names, carry=["host", "grams", "row", "__hash"])
    assert found.columns == ["doc_id", "host", "grams", "row", "__hash", "language", "confidence", "kept"] and found.filter("row = 'r' and grams = 1 and host is not null").count() == docs.count()
    assert drop_unknown(names).columns == names.columns and drop_unknown(names).filter("__hash = 2").count() > 0


def test_pages_of_open_tags_take_linear_time(spark):
    import re
    import time

    from pyspark.sql import functions as F

    from millrace.llm import language_id as L

    for unit in ("<a", "<html", "<!--", "<script", "</script ", "<html lang ", "<", "<a>", "<!", "<html xml:lang = "):
        page = unit * (1_000_000 // len(unit))
        began = time.perf_counter()
        L.seen_text(page)
        assert time.perf_counter() - began < 1, unit
        rows = spark.createDataFrame([(page,)], "html string").select(F.regexp_extract("html", L._DECLARED, 1).alias("d"))
        began = time.perf_counter()
        rows.collect()
        assert time.perf_counter() - began < 3, unit
    plain = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|</?[A-Za-z!?][^>]*>", re.S | re.I)
    for page in ("a <b>c</b> d", "x <!-- y > z", "x <!-- y > z --> w <i", "<script>a > b", "a > b <script c", "a <style> b </style > c <p", "a <p", "a > b <!-- c", "1 < 2 > 0 <b", "", ">", "<a<b<c>d", "<!-- <script> --> t <script> </SCRIPT> u"):
        assert L.seen_text(page) == L.html.unescape(plain.sub(" ", page)), page

import json

from pyspark.sql import functions as F

from millrace.operators import open_answers as O
from millrace.operators.annotate import AnnotateSpec, annotate
from millrace.operators.progress import Progress, run_annotation
from millrace.providers import ProviderSpec
from millrace.queries import LastMessageProvider
from tests.test_annotate import prepared, texts

ANSWERS = [{"label": "a", "more": {"n": 1, "odd key": [1, 2]}}, {"label": "b", "more": {"n": 2.5}}, {"label": "c"}, {"label": "d", "more": "text", "x": float("inf")}, {"label": "e", "x": None}, "no json", ["list"]]


def answered(spark, tmp_path, wave_rows=None):
    rows = spark.createDataFrame([(k, json.dumps(a) if not isinstance(a, str) else a) for k, a in enumerate(ANSWERS)], "idx long, text string")
    spec = AnnotateSpec(ProviderSpec(LastMessageProvider), {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}, num_retries_invalid=0)
    progress = Progress(spark, f"file://{tmp_path}/run")
    from millrace.plans.prepare import PrepareSpec, prepare

    return run_annotation(prepare(rows, PrepareSpec("{text}")), spec, progress, wave_rows=wave_rows), progress


def test_keys_beyond_the_schema_are_variants(spark, tmp_path):
    found, progress = answered(spark, tmp_path, 3)
    assert dict(found.dtypes)["extra"] == "variant"
    typed = O.extracted(found, "extra", {"n": ("$.more.n", "double"), "as_int": ("$.more.n", "int"), "first": ("$.more['odd key'][0]", "int"), "x": ("$.x", "string")})
    got = [(r.n, r.as_int, r["first"], r.x) for r in typed.orderBy("idx").collect()]
    assert got == [(1.0, 1, 1, None), (2.5, 2, None, None), (None,) * 4, (None, None, None, "inf"), (None,) * 4, (None,) * 4, (None,) * 4]
    schema = progress.open_schema("extra")
    assert O.leaves(schema) == {"$.more": "VARIANT", "$.x": "STRING"}
    # Rows read back later are the same.
    assert found.filter("extra is not null").count() == 4


def test_schemas_merge():
    assert O.merged_schemas([]) == "VOID" and O.merged_schemas(["VOID", "OBJECT<a: BIGINT>"]) == "OBJECT<a: BIGINT>"
    assert O.merged_schemas(["OBJECT<a: BIGINT, b: OBJECT<c: STRING>>", "OBJECT<a: DOUBLE, b: OBJECT<d: BOOLEAN>>"]) == "OBJECT<a: DOUBLE, b: OBJECT<c: STRING, d: BOOLEAN>>"
    assert O.merged_schemas(["OBJECT<a: ARRAY<BIGINT>>", "OBJECT<a: ARRAY<STRING>>"]) == "OBJECT<a: ARRAY<VARIANT>>"
    assert O.merged_schemas(["OBJECT<a: BIGINT>", "OBJECT<a: STRING>"]) == "OBJECT<a: VARIANT>"
    assert O.leaves("OBJECT<a: OBJECT<`odd key`: BIGINT>, b: STRING>") == {"$.a['odd key']": "BIGINT", "$.b": "STRING"}


def test_merging_equals_one_pass(spark):
    values = ['{"a": 1, "b": {"c": "x"}}', '{"a": 2}', '{"b": {"d": true}}', '{"a": null, "e": [1, 2]}', '{"e": []}']
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(F.parse_json("t").alias("v"))
    parts = [O.shared_schema(spark.createDataFrame([(v,)], "t string").select(F.parse_json("t").alias("v")), "v") for v in values]
    assert O.merged_schemas(parts) == O.shared_schema(rows, "v")
    assert O.shared_schema(rows.limit(0), "v") == "VOID"


def test_numbers_beyond_json_become_text():
    assert O.plain({"a": [float("nan"), 1.5, {"b": float("-inf")}]}) == {"a": ["nan", 1.5, {"b": "-inf"}]}


def test_rows_without_further_keys(spark):
    out = annotate(prepared(spark, 2), AnnotateSpec(ProviderSpec("echo"), {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}))
    assert out.filter("extra is not null").isEmpty() and texts(spark, 1).count() == 1

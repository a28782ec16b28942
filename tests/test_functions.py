import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions.schemas import as_schema, close_objects, drop_integer_bounds, fitted, inline_definitions, property_fields, spark_type
from millrace.plans.template import PromptTemplate, TemplateError


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_compact_number(spark):
    cases = {0: "0", 42: "42", 999: "999", 1_000: "1K", 1_234: "1.2K", 1_234_567: "1.2M", 1_000_000_000: "1B", 1_250_000_000: "1.2B", 999_999: "1000K", None: None}
    assert one(column(spark, list(cases), "long").repartition(1), S.compact_number("v")) == list(cases.values())


def test_prompt_length_is_that_of_json(spark):
    rng = random.Random(0)
    texts = ["".join(chr(rng.choice([rng.randrange(0, 160), rng.randrange(0x100, 0xD800), rng.randrange(0x10000, 0x1F000), 34, 92, 127])) for _ in range(40)) for _ in range(200)]
    table = spark.createDataFrame([(k, [{"role": "system", "content": "é"}] * (k % 2) + [{"role": "user", "content": t}]) for k, t in enumerate(texts)], "k long, m array<struct<role:string,content:string>>")
    for r in table.select("m", S.prompt_length(F.col("m")).alias("n")).collect():
        assert r.n == len(json.dumps([x.asDict() for x in r.m]))


def test_words_and_quality(spark):
    texts = ["a b  c\n", "", "one two three", "x" * 300, "A sentence. " * 40]
    assert one(column(spark, texts), S.n_words(F.col("v"))) == [len(t.split()) for t in texts]
    assert one(column(spark, texts), S.passes_quality(F.col("v"))) == [False, False, False, False, True]


def sections(text):
    """The same rule, line by line."""
    out, lines, title, index = [], [], "", -1
    for line in text.splitlines():
        if line.startswith("# "):
            continue
        if line.startswith("## "):
            if lines:
                out.append((title, "\n".join(lines), index))
            lines, title, index = [], line[3:].strip(), index + 1
        elif index > 0:
            lines.append(line)
    return out + ([(title, "\n".join(lines), index)] if lines else [])


def test_sections(spark):
    texts = ["intro\n## a\nlost\n## b\nx\n# skip\ny\n## c\n## d\nz", "## only\nbody", "", "no heading", "## a\n## b \n\n\nq\n"]
    got = one(column(spark, texts), S.sections(F.col("v")))
    assert [[tuple(s) for s in g] for g in got] == [sections(t) for t in texts]


def test_truncation_and_ranges(spark):
    assert one(column(spark, ["abcdef"]), S.truncate(F.col("v"), 3, S.TRUNCATED)) == ["abc\n<truncated_content>"]
    assert one(column(spark, ["abcdef"]), S.truncate(F.col("v"), 0, S.TRUNCATED)) == ["abcdef"]
    assert one(column(spark, [1, 2, 3], "int"), S.in_range(F.col("v"), 2, None)) == [False, True, True]


def test_system_message_must_be_single_and_first(spark):
    s, u = {"role": "system", "content": "s"}, {"role": "user", "content": "u"}
    table = spark.createDataFrame([([s, u],), ([u],), ([u, s],), ([s, s, u],)], "m array<struct<role:string,content:string>>")
    got = one(table, S.split_system(F.col("m")))
    assert [(g.system, g.valid, len(g.messages)) for g in got] == [("s", True, 1), (None, True, 1), (None, False, 1), (None, False, 1)]


@pytest.mark.parametrize("source", ["{a:>3}", "{a!r}", "{}", "{a.b}", "{0x", "}"])
def test_bad_templates(source):
    with pytest.raises(ValueError):
        PromptTemplate.parse(source)


def test_rendering_is_that_of_format(spark):
    source = "{{{s}}} {n} {f} {b} {s}"
    rows = [("x", 1, 2.5, True), (None, None, None, None), ("{n}", -7, 1e16, False), ("", 0, 1e-5, True), ("é", 3, 123456789.125, True), ("e", 1, float("nan"), True), ("e", 1, float("-inf"), True), ("m", 2, -1.5e-3, False), ("m", 2, 1234567890123456.0, False), ("m", 2, 1e22, False)]
    table = spark.createDataFrame(rows, "s string, n long, f double, b boolean")
    template = PromptTemplate.parse(source)
    assert template.names == ["s", "n", "f", "b"] and template.prefix == "{"
    assert one(table, template.column(table)) == [source.format(s=s, n=n, f=f, b=b) for s, n, f, b in rows]
    with pytest.raises(TemplateError, match="'z' is not among"):
        PromptTemplate.parse("{z}").column(table)
    assert PromptTemplate.parse("{s}").swapped({"s": "n"}).names == ["n"]


SCHEMA = {"type": "object", "properties": {"t": {"type": "string", "enum": ["a"]}, "n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "items": {"type": "number"}}, "o": {"type": "object", "properties": {"b": {"type": "boolean"}}}, "m": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "x": {}}}


def test_types_of_schemas():
    assert spark_type(SCHEMA).simpleString() == "struct<t:string,n:bigint,l:array<double>,o:struct<b:boolean>,m:bigint,x:string>"
    assert [f.name for f in property_fields(SCHEMA)] == list("tnlomx") and property_fields(None) == []
    value = {"t": 1, "n": 2.0, "l": [1, "x"], "o": {"b": True}, "m": None, "x": {"y": 1}}
    assert fitted(value, spark_type(SCHEMA)) == {"t": "1", "n": 2, "l": [1.0, None], "o": {"b": True}, "m": None, "x": '{"y": 1}'}
    with pytest.raises(TypeError):
        as_schema("[1]")


def test_rewrites_of_schemas():
    closed = close_objects({"type": "object", "properties": {"o": {"type": "array", "items": {"type": "object"}}, "k": {"type": "object", "additionalProperties": True}}})
    assert closed["additionalProperties"] is False and closed["properties"]["o"]["items"]["additionalProperties"] is False and closed["properties"]["k"]["additionalProperties"] is True
    assert "minimum" not in drop_integer_bounds(SCHEMA)["properties"]["n"] and "minimum" in SCHEMA["properties"]["n"]
    refs = {"$defs": {"I": {"type": "object", "properties": {"n": {"type": "string"}}}}, "properties": {"a": {"$ref": "#/$defs/I", "title": "T"}, "e": {"$ref": "https://x/y"}, "m": {"anyOf": [{"$ref": "#/$defs/I"}, {"type": "null"}]}}}
    flat = inline_definitions(refs)
    assert "$defs" not in flat and flat["properties"]["a"]["title"] == "T" and flat["properties"]["a"]["type"] == "object"
    assert flat["properties"]["e"]["$ref"] == "https://x/y" and flat["properties"]["m"]["anyOf"][0]["type"] == "object"
    with pytest.raises(ValueError):
        inline_definitions({"$defs": {"A": {"$ref": "#/$defs/A"}}, "p": {"$ref": "#/$defs/A"}})


def test_document_properties():
    from millrace.functions.properties import ANY_OF, ONE_OF, ORDER, property_messages, property_schema, property_schema_text

    assert len(ORDER) == 18 and {len(v) for v in ANY_OF.values()} == {18, 37, 7, 14} and sum(map(len, ONE_OF.values())) == 55
    schema = property_schema(flat=False)
    assert schema["x-guidance"]["whitespace_flexible"] is False and "Valid values:" in schema["properties"]["country_relevance"]["description"]
    text = property_schema_text(small=False, countries=["Norway"], compact=False)
    assert "\n" in text and "$defs" not in text and "Norway" in text
    assert spark_type(json.loads(text)["properties"]["content_type"]).simpleString() == "array<string>"
    system, user = property_messages("abcdef", "guide", 3)
    assert system["content"] == "guide" and "abc\n<truncated_content>" in user["content"] and "<start_of_document>" in user["content"]


def test_measures_of_odd_texts(spark):
    rng = random.Random(1)
    odd = '"\\\b\f\n\r\t\x00\x1f\x7f\x80\u00e9\u2028\uffff\U0001f600 ab[]{}~!#'
    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2003\u2028\u3000"
    texts = ["", " ", None, *("".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(200)), *("".join(rng.choices(blanks + "xyz", k=rng.randint(1, 20))) for _ in range(200))]
    table = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for r in table.select("k", S.json_text_length(F.col("t")).alias("n"), S.n_words(F.col("t")).alias("w")).collect():
        t = texts[r.k]
        assert (r.n, r.w) == ((None, None) if t is None else (len(json.dumps(t)) - 2, len(t.split()))), repr(t)

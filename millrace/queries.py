"""Queries over the driver's tables, one for each operator, with the SQL that checks them."""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import DatasetConfig, PipelineConfig, catalog_text
from millrace.functions import scalar as S
from millrace.functions.properties import ORDER as PROPERTIES
from millrace.functions.properties import property_schema
from millrace.operators import tables as R
from millrace.operators.annotate import AnnotateSpec, annotate, batch_number, batched
from millrace.operators.donebits import bitmaps, merged, skip_set
from millrace.operators.open_answers import extracted
from millrace.operators.progress import Progress, run_annotation
from millrace.operators.wave_stats import RANK_ERROR, counted, token_percentiles
from millrace.pipeline import run_pipeline
from millrace.plans.annotator import annotate_dataset, generate_dataset
from millrace.plans.prepare import PrepareSpec, assign_index, generated, numbered, prepare, prepare_data, shuffled
from millrace.plans.source_order import in_source_order
from millrace.plans.template import PromptTemplate, TemplateError
from millrace.providers import Messages, Provider, ProviderError, ProviderSpec, Response, RuntimeOptions, UnavailableError
from millrace.providers.http import OpenAIOptions
from millrace.providers.pool import first_server
from millrace.sources.tables import count_lines, exists, list_files, load_dataset, read_jsonl, read_prompts, read_text, remove_empty_files, write_jsonl, write_text
from millrace.streaming.done_state import annotate_once
from millrace.streaming.resume import counts_stream, total_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SYSTEM = "You label texts."
LABEL_SCHEMA = {"type": "object", "properties": {"label": {"type": "string"}, "score": {"type": "integer"}}, "required": ["label"]}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; below the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def echo(**options) -> AnnotateSpec:
    return AnnotateSpec(ProviderSpec("echo"), **options)


def prompted(df: DataFrame, key: str, template: str, system: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their own key as index and rendered messages."""
    return prepare(df.withColumn("idx", F.col(key)), PrepareSpec(template, system, keep_columns=keep))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def assign_idx(spark, sf_dir):
    return assign_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::varchar), doc_id) AS rank FROM documents ORDER BY rank LIMIT 50")
def seeded_shuffle_limit(spark, sf_dir):
    rows = shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42).limit(50)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id")))


@query("SELECT doc_id AS idx, 'Classify (' || lang || ', ' || n_chars || ' chars): ' || text AS prompt FROM documents")
def render_prompt(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "Classify ({lang}, {n_chars} chars): {text}")
    return rows.select("idx", F.col("messages")[0]["content"].alias("prompt"))


@query("SELECT doc_id AS idx, 'Quality ' || coalesce(quality::varchar, 'None') || ' of ' || source AS prompt FROM documents LEFT JOIN labels USING (doc_id)")
def render_null_and_int(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return prompted(rows, "doc_id", "Quality {quality} of {source}").select("idx", F.col("messages")[0]["content"].alias("prompt"))


@query("SELECT c_custkey AS idx, 'Balance {' || c_acctbal::varchar || '}' AS prompt FROM customer")
def render_double_and_braces(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "customer"), "c_custkey", "Balance {{{c_acctbal}}}")
    return rows.select("idx", F.col("messages")[0]["content"].alias("prompt"))


@query(f"SELECT doc_id AS idx, 0 AS pos, 'system' AS role, '{SYSTEM}' AS content FROM documents UNION ALL SELECT doc_id, 1, 'user', 'Text: ' || text FROM documents")
def build_messages(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "Text: {text}", SYSTEM)
    return rows.select("idx", F.posexplode("messages").alias("pos", "m")).select("idx", "pos", "m.role", "m.content")


_LENGTH = r"""length(t) + length(regexp_replace(t, '[^"\\\x08\x0c\n\r\t]', '', 'g')) + 5 * length(regexp_replace(t, '[^\x00-\x07\x0b\x0e-\x1f\x7f]', '', 'g'))
 + 5 * length(regexp_replace(t, '[^\x{80}-\x{ffff}]', '', 'g')) + 11 * length(regexp_replace(t, '[^\x{10000}-\x{10ffff}]', '', 'g'))"""


@query(f"SELECT doc_id AS idx, CAST({_LENGTH} + 33 AS BIGINT) AS length FROM (SELECT doc_id, text AS t FROM documents)")
def prompt_length_key(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{text}")
    return rows.select("idx", S.prompt_length(F.col("messages")).cast("long").alias("length"))


@query(f"SELECT doc_id AS idx, row_number() OVER (ORDER BY {_LENGTH} DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, text AS t FROM documents)")
def sort_by_length(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{text}").select(F.col("idx").alias("id"), (-S.prompt_length(F.col("messages"))).alias("key"))
    # The index reads the keys three times; they are computed once.
    where = work_dir(spark)
    rows.write.parquet(where)
    return assign_index(spark.read.parquet(where), ["key", "id"], "rank").select(F.col("id").alias("idx"), "rank")


@query("SELECT doc_id AS idx, 'Classify: ' || lang AS prompt FROM documents")
def field_swap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    template = PromptTemplate.parse("Classify: {text}").swapped({"text": "lang"})
    return docs.select(F.col("doc_id").alias("idx"), template.column(docs).alias("prompt"))


@query("SELECT doc_id AS idx, lang, length(text) + 3 AS n FROM documents")
def prune_columns(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "T: {text}", keep=("lang",))
    return rows.select("idx", "lang", F.length(F.col("messages")[0]["content"]).cast("long").alias("n"))


@query("SELECT row_number() OVER () - 1 AS idx, 'Write a fact on ' || (SELECT min(source) FROM documents) AS prompt FROM documents")
def generate_repeat(spark, sf_dir):
    """One prompt, as often as there are documents."""
    docs = table(spark, sf_dir, "documents").agg(F.min("source").alias("source"), F.count("*").alias("n")).first()
    return generated(spark, f"Write a fact on {docs.source}", docs.n).select("idx", "prompt")


@query("SELECT doc_id AS idx, lang, 'Say: ' || text AS response, 'stop' AS finish_reason, 3 AS num_tokens, NULL::varchar AS error, NULL::varchar AS error_type FROM documents")
def echo_annotate(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "Say: {text}", keep=("lang",))
    return annotate(rows, echo(keep_columns=("lang",))).drop("messages")


@query("SELECT doc_id AS idx, true AS valid_fields, 'label::' || source AS label, 4::BIGINT AS score FROM documents")
def echo_schema(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{source}")
    return annotate(rows, echo(output_schema=LABEL_SCHEMA)).select("idx", "valid_fields", "label", "score")


PROPS_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}


def _answered_by_props(spark, sf_dir, required: str) -> DataFrame:
    schema = {**PROPS_SCHEMA, "required": [required]}
    rows = prompted(table(spark, sf_dir, "events"), "event_id", "{props}")
    return annotate(rows, AnnotateSpec(ProviderSpec(LastMessageProvider), output_schema=schema, num_retries_invalid=0))


class LastMessageProvider(Provider):
    """Answers with the last message as it is."""

    name = "last_message"

    def __init__(self, model: str = "", **kwargs):
        super().__init__(model, **kwargs)

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        return Response(messages[-1]["content"], "stop", None, self.name)


class FailingProvider(LastMessageProvider):
    """Fails for messages whose number is even; unfinished for those divisible by 3."""

    name = "failing"

    def __init__(self, model: str = "", **kwargs):
        super().__init__(model, **{"on_error": "ignore", **kwargs})

    def finished(self, reason: str | None) -> bool:
        return reason == "stop"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        n = int(messages[-1]["content"])
        if n % 2 == 0:
            raise ProviderError("even")
        return Response(str(n), "length" if n % 3 == 0 else "stop", None, self.name)


@query("SELECT event_id AS idx, true AS valid_fields, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_required(spark, sf_dir):
    return _answered_by_props(spark, sf_dir, "k").select("idx", "valid_fields", "k")


@query("SELECT event_id AS idx, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::varchar AS none, 'OBJECT<k: BIGINT>' AS schema FROM events")
def answers_of_any_keys(spark, sf_dir):
    """Answers of keys that no schema names, in two waves: a typed path, one that no row has, and the schema of both waves."""
    rows = prompted(table(spark, sf_dir, "events"), "event_id", "{props}")
    spec = AnnotateSpec(ProviderSpec(LastMessageProvider), output_schema={"type": "object", "properties": {"other": {"type": "string"}}}, num_retries_invalid=0)
    progress = Progress(spark, work_dir(spark))
    found = run_annotation(rows, spec, progress, wave_rows=max(1, rows.count() // 2))
    typed = extracted(found, "extra", {"k": ("$.k", "long"), "none": ("$.none", "string")})
    return typed.select("idx", "k", "none", F.lit(progress.open_schema("extra")).alias("schema"))


@query("SELECT event_id AS idx, false AS valid_fields, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_missing_required(spark, sf_dir):
    return _answered_by_props(spark, sf_dir, "absent").select("idx", "valid_fields", "k")


@query("""SELECT doc_id AS idx, doc_id % 4 < 3 AS valid_fields, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 + 1 END AS attempt,
 CASE WHEN doc_id % 4 < 3 THEN 5 ELSE 2 END AS num_tokens FROM documents""")
def retry_rounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", F.col("doc_id") % 4)
    schema = {"type": "object", "properties": {"attempt": {"type": "integer"}}, "required": ["attempt"]}
    rows = prompted(docs, "doc_id", "fail:{n} {doc_id}")
    found = annotate(rows, AnnotateSpec(ProviderSpec("scripted"), output_schema=schema, num_retries_invalid=2))
    return found.select("idx", "valid_fields", "attempt", "num_tokens")


@query("""SELECT doc_id AS idx, CASE WHEN doc_id % 2 = 0 THEN '' ELSE doc_id::varchar END AS response,
 CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
 CASE WHEN doc_id % 2 = 0 THEN 'even' WHEN doc_id % 3 = 0 THEN 'generation stopped: length' END AS error,
 CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'ProviderError' END AS error_type FROM documents""")
def error_rows(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{doc_id}")
    return annotate(rows, AnnotateSpec(ProviderSpec(FailingProvider))).select("idx", "response", "finish_reason", "error", "error_type")


def _short_answer(row: dict) -> bool:
    return 100 <= len(row["response"]) <= 2000


@query("SELECT doc_id AS idx, length(text) BETWEEN 100 AND 2000 AS valid FROM documents")
def validate_length_range(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{text}")
    return annotate(rows, echo(validate=_short_answer, num_retries_invalid=1)).select("idx", "valid")


def _shout(row: dict) -> dict:
    return {**row, "shout": row["response"].upper()}


@query("SELECT doc_id AS idx, upper(lang) AS shout FROM documents")
def postprocess_hook(spark, sf_dir):
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{lang}")
    return annotate(rows, echo(postprocess=_shout, extra_columns="shout string")).select("idx", "shout")


@query("SELECT quality, toxic, quality >= 1 AS at_least, quality BETWEEN 0 AND 0 AS both, true AS free, count(*) AS n FROM labels GROUP BY ALL")
def range_predicates(spark, sf_dir):
    q = F.col("quality")
    marked = table(spark, sf_dir, "labels").select("quality", "toxic", S.in_range(q, 1).alias("at_least"), S.in_range(q, 0, 0).alias("both"), S.in_range(q).alias("free"))
    return marked.groupBy(*marked.columns).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'end_turn' WHEN 3 THEN 'stop_sequence' END AS reason FROM events)
SELECT reason, coalesce(reason = 'stop', false) AS openai, coalesce(reason IN ('end_turn', 'stop_sequence'), true) AS claude, coalesce(reason = 'stop', true) AS vllm, count(*) AS n FROM r GROUP BY ALL""")
def stop_reason_class(spark, sf_dir):
    k = F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select(F.when(k == 0, "stop").when(k == 1, "length").when(k == 2, "end_turn").when(k == 3, "stop_sequence").alias("reason"))
    reason = F.col("reason")
    rows = rows.select("reason", S.is_finished("openai", reason).alias("openai"), S.is_finished("claude", reason).alias("claude"), S.is_finished("vllm_offline", reason).alias("vllm"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality = 1 AS valid_fields FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1")
def filter_invalid(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.filter_invalid(rows.select("doc_id", (F.col("quality") == 1).alias("valid_fields")))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    done = R.done_rows(table(spark, sf_dir, "labels"), "doc_id")
    return R.skip_done(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("SELECT DISTINCT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def resume_scoped_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.done_rows(rows, "doc_id", quality=1)


@query("SELECT doc_id, quality, toxic, NULL::varchar AS lang FROM labels UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents")
def progress_union(spark, sf_dir):
    """Two committed waves of different columns, read back as one table."""
    progress = Progress(spark, work_dir(spark))
    progress.append(table(spark, sf_dir, "labels"))
    progress.append(table(spark, sf_dir, "documents").select("doc_id", "lang"))
    return progress.read().select("doc_id", "quality", "toxic", "lang")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first_idx(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT doc_id, sha256(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_sha256(spark, sf_dir):
    return R.dedup_by_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", S.sha256_hex(F.col("text")).alias("digest"))


@query("SELECT o_orderkey // 256 AS batch, count(*) AS n, min(o_orderkey) AS first, 1 AS tasks, true AS ordered FROM orders GROUP BY 1")
def batch_assignment(spark, sf_dir):
    """Batches as the tasks get them: each whole in one task, in order."""
    dealt = batched(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 256, "o_orderkey", 16)
    place = dealt.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    numbered = place.withColumn("batch", batch_number(F.col("o_orderkey"), 256))
    ordered = F.col("at") - F.min("at").over(Window.partitionBy("batch")) == F.row_number().over(Window.partitionBy("batch").orderBy("o_orderkey")) - 1
    return numbered.withColumn("fits", ordered).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.count_distinct("task").cast("int").alias("tasks"), F.min("fits").alias("ordered"))


@query("""SELECT n AS rows, count(*) AS files FROM (SELECT k // 1000 AS file, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS k FROM orders) GROUP BY 1) GROUP BY 1""")
def file_index(spark, sf_dir):
    """Rows of the files that one task's progress rotates through."""
    progress = Progress(spark, work_dir(spark), rows_per_file=1000)
    progress.append(table(spark, sf_dir, "orders").select("o_orderkey").repartition(1))
    files = progress.read().groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return files.groupBy("rows").agg(F.count("*").alias("files"))


@query("SELECT (o_orderkey // 256) % 4 AS server, count(DISTINCT o_orderkey // 256) AS batches, count(*) AS n FROM orders GROUP BY 1")
def server_round_robin(spark, sf_dir):
    """The servers that answer the batches of all orders: a task begins with a server of its own and goes round."""
    servers, tasks = 4, int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 256").alias("batch")).agg(F.count("*").alias("n"))
    # Four neighbouring batches are a round. Gaps are asked as well, with no orders, so that each round takes every server.
    number, below = F.abs("batch"), F.col("batch") < 0
    turns = F.map_from_entries(F.collect_list(F.struct(first_server(number, servers).alias("turn"), "n")))
    rounds = batches.filter("batch is not null").groupBy(below.alias("below"), F.floor(number / servers).alias("round")).agg(turns.alias("turns"))
    asked = rounds.select("below", "round", F.explode(F.sequence(F.lit(0), F.lit(servers - 1))).alias("turn"), "turns")
    asked = asked.withColumn("n", F.coalesce(F.element_at("turns", F.col("turn").cast("long")), F.lit(0))).withColumn("task", F.pmod(F.hash("below", "round"), F.lit(tasks)))
    rows = prompted(asked, "round", "{n}", keep=("below", "task", "turn"))
    dealt = rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("below", "idx", F.pmod(F.col("turn") - F.col("task"), F.lit(servers)))
    spec = AnnotateSpec(ProviderSpec(ServedProvider, base_urls=tuple(str(k) for k in range(servers))), keep_columns=("below",), batch_size=1, queue_size=servers, pool_tasks=servers)
    server, n = (F.substring_index("response", ":", k).cast("long") for k in (1, -1))
    # The remainder of a key below zero is below zero, and orders without a key are in no batch.
    answered = annotate(dealt, spec).select(F.when(F.col("below"), -server).otherwise(server).alias("server"), n.alias("n")).filter("n > 0")
    unnumbered = batches.filter("batch is null").select(F.lit(None).cast("long").alias("server"), "n")
    counted = answered.withColumn("batches", F.lit(1)).unionByName(unnumbered.withColumn("batches", F.lit(0)))
    return counted.groupBy("server").agg(F.sum("batches").alias("batches"), F.sum("n").alias("n"))


class ServedProvider(Provider):
    """Answers with its server's name and the message; the server ``down`` cannot be reached, ``slow`` takes its time."""

    name = "served"

    def __init__(self, model: str = "", base_url: str = "", **kwargs):
        super().__init__(model, **{"on_error": "ignore", **kwargs})
        self.base_url = base_url

    def batch(self, batch, options: RuntimeOptions, **extra) -> list[Response]:
        if self.base_url == "slow":
            time.sleep(0.05)
        return super().batch(batch, options, **extra)

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        if self.base_url == "down":
            raise UnavailableError("no route")
        return Response(f"{self.base_url}:{messages[-1]['content']}", "stop", None, self.name)


@query("SELECT doc_id AS idx, lang AS said, true AS by_a_server, NULL::varchar AS error FROM documents")
def server_pool(spark, sf_dir):
    """Every batch is answered once, by a server that can be reached."""
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "{lang}").repartition(3)
    spec = AnnotateSpec(ProviderSpec(ServedProvider, base_urls=("down", "slow", "quick")), batch_size=16, queue_size=6, pool_tasks=3)
    found = annotate(rows, spec)
    server, said = F.substring_index("response", ":", 1), F.substring_index("response", ":", -1)
    return found.select("idx", said.alias("said"), server.isin("slow", "quick").alias("by_a_server"), "error")


@query("""WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS finish_reason, lang AS error_type, quality = 1 AS valid_fields FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'finish_reason' AS what, coalesce(finish_reason, 'none') AS value, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'error_type', coalesce(error_type, 'none'), count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'valid_fields', CASE WHEN valid_fields IS NULL THEN 'none' WHEN valid_fields THEN 'valid' ELSE 'invalid' END, count(*) FROM r GROUP BY ALL""")
def metadata_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.metadata_counts(rows.select(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("finish_reason"), F.col("lang").alias("error_type"), (F.col("quality") == 1).alias("valid_fields")))


_AT = ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 6) AS p{str(p).removesuffix('.0').replace('.', '_')}" for p in R.PERCENTILES)


@query(f"SELECT round(avg(n_chars), 6) AS mean, min(n_chars) AS min, max(n_chars) AS max, {_AT} FROM documents")
def token_stats(spark, sf_dir):
    stats = R.token_stats(table(spark, sf_dir, "documents"), "n_chars")
    return stats.select(*[c if c in ("min", "max") else F.round(c, 6).alias(c) for c in stats.columns])


_SHORT = " ".join(f"WHEN n >= {size} THEN regexp_replace(printf('%.1f', n / {size}.0::double), '\\.0$', '') || '{unit}'" for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")))


@query(f"SELECT o_orderkey, CASE {_SHORT} ELSE n::varchar END AS short FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 AS n FROM orders)")
def compact_number(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 7
    return table(spark, sf_dir, "orders").select("o_orderkey", S.compact_number(n).alias("short"))


@query("SELECT n_nationkey, 'Say ' || n_name || ': ' AS prefix FROM nation")
def prompt_prefix(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.template_prefix(F.concat(F.lit("Say "), "n_name", F.lit(": {text} and {lang}"))).alias("prefix"))


_WORDS = r"len(regexp_extract_all(text, '\S+'))"


@query(f"SELECT doc_id FROM documents WHERE {_WORDS} >= 75")
def min_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.n_words(F.col("text")) >= 75).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE (length(text || ' ') - length(replace(text || ' ', '. ', ''))) / 2 >= 3 AND {_WORDS} > 30 AND {_WORDS} < 24000 AND length(text) > 200 AND length(text) < 72000")
def quality_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.passes_quality(F.col("text"))).select("doc_id")


@query("SELECT doc_id, length(text) <= 768 AS short FROM documents")
def short_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.length_in_range(F.col("text"), None, 768).alias("short"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def stub_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.is_stub(F.col("text"), "Licensed Under")).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'part 1') OR starts_with(lower(p_name), 'b')")
def title_prefix(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").filter(S.title_starts_with(name, "Part 1") | S.title_starts_with(name, "B")).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE n_chars <= 500")
def token_limit(spark, sf_dir):
    return R.within_token_limit(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", 500)


@query("SELECT doc_id, substr(text, 1, 500) AS text FROM documents")
def truncate_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text"), 500).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '<truncated_content>' ELSE text END AS text, text AS whole FROM documents")
def truncate_marker(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(text, 500, S.TRUNCATED).alias("text"), S.truncate(text, 0, S.TRUNCATED).alias("whole"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)
SELECT conv_id, CAST(i AS INTEGER) AS section, role AS heading, text FROM t WHERE i >= 1""")
def section_explode(spark, sf_dir):
    part = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    found = turns.select("conv_id", F.explode(S.sections(F.array_join("parts", "\n"))).alias("s"))
    return found.select("conv_id", F.col("s.index").alias("section"), "s.heading", "s.text")


@query("""SELECT conv_id, count(*) FILTER (role <> 'system') AS n, max(text) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id""")
def system_split(spark, sf_dir):
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("messages"))
    split = turns.select("conv_id", S.split_system(F.col("messages")).alias("s"))
    return split.select("conv_id", F.size("s.messages").cast("long").alias("n"), "s.system")


@query("""SELECT r_regionkey, 'Nations:' || chr(10) || string_agg('- `' || n_nationkey || '` — ' || n_name, chr(10) ORDER BY n_nationkey) AS catalog
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def catalog_render(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_regionkey").agg(S.catalog(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_nationkey"), "Nations:").alias("catalog"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal FROM supplier")
def rename_drop(spark, sf_dir):
    return R.drop(R.rename(table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "name"}), ["s_nationkey"])


@query("SELECT item_id, text, 'question::Ask: ' || text AS question_v1, 'answer::Rate: question::Ask: ' || text AS answer FROM benchmark")
def two_step_pipeline(spark, sf_dir):
    """A pipeline of two steps; the second reads what the first wrote and renamed."""
    schema = lambda name: {"type": "object", "properties": {name: {"type": "string"}}, "required": [name]}
    steps = [
        {"name": "ask", "prompt": "Ask: {text}", "output_schema": schema("question"), "filter_invalid": True, "rename": {"question": "question_v1"}},
        {"name": "rate", "prompt": "Rate: {question_v1}", "output_schema": schema("answer"), "filter_invalid": True},
    ]
    config = PipelineConfig(work_dir(spark), steps, DatasetConfig(path=f"{sf_dir}/benchmark.parquet"), {"provider": "echo"})
    return run_pipeline(spark, config).select("item_id", "text", "question_v1", "answer")


@query("SELECT doc_id AS idx, 'Again: ' || lang AS response FROM documents")
def crash_and_resume(spark, sf_dir):
    """A run that stops after two waves, and one that does the rest."""
    progress = Progress(spark, work_dir(spark))
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "Again: {lang}")
    wave = max(1, rows.count() // 4)
    run_annotation(rows, echo(), progress, wave_rows=wave, max_waves=2)
    return run_annotation(rows, echo(), progress, wave_rows=wave).select("idx", "response")


@query("SELECT doc_id AS idx, 'B ' || source AS response FROM documents")
def changed_input_is_not_reused(spark, sf_dir):
    """A run with one template stops after two waves; one with another in the same folder answers every row anew."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang", "source")
    wave = max(1, docs.count() // 4)
    annotate_dataset(docs, where, echo(), "A {lang}", wave_rows=wave, max_waves=2)
    annotate_dataset(docs.filter("idx % 2 = 0"), where, echo(), "B {source}", wave_rows=wave)
    return annotate_dataset(docs, where, echo(), "B {source}", wave_rows=wave).select("idx", "response")


@query(f"SELECT batch, n, longest, shortest FROM (SELECT rank // 64 AS batch, count(*) AS n, max(length) AS longest, min(length) AS shortest FROM (SELECT {_LENGTH} AS length, row_number() OVER (ORDER BY {_LENGTH} DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, text AS t FROM documents)) GROUP BY 1)")
def length_sorted_batches(spark, sf_dir):
    """Batches that reach the model when prompts are sorted by length: rows, and the longest and shortest as written in JSON."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    spec = AnnotateSpec(ProviderSpec(BatchLengthProvider), batch_size=64)
    rows = prepare(docs, PrepareSpec("{text}", sort_by_length=True))
    found = run_annotation(rows, spec, Progress(spark, work_dir(spark)), partitions=4)
    told = F.split("response", " ")
    per = found.select(*[told[k].cast("long").alias(n) for k, n in enumerate(("n", "longest", "shortest"))]).withColumn("one", F.lit(1))
    batches = per.groupBy("n", "longest", "shortest").agg(F.count("*").alias("rows")).withColumn("times", F.explode(F.expr("sequence(1, cast(rows / n AS int))")))
    return assign_index(batches.select((-F.col("longest")).alias("a"), (-F.col("shortest")).alias("b"), (-F.col("n")).alias("c"), "times"), ["a", "b", "c", "times"], "batch").select("batch", (-F.col("c")).alias("n"), (-F.col("a")).alias("longest"), (-F.col("b")).alias("shortest"))


class BatchLengthProvider(LastMessageProvider):
    """Answers with the number of messages in the batch and the lengths of the longest and shortest."""

    name = "batch_length"

    def batch(self, batch, options: RuntimeOptions, **extra) -> list[Response]:
        sizes = [len(json.dumps(m[-1]["content"])) - 2 for m in batch]
        return [Response(f"{len(sizes)} {max(sizes)} {min(sizes)}", "stop", None, self.name) for _ in sizes]


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_resume(spark, sf_dir):
    """Two runs over one checkpoint: the second adds nothing."""
    where = work_dir(spark)
    name = "events.parquet"
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(sf_dir)
        counts_stream(source, "event_type", f"{where}/out", f"{where}/checkpoint")
    return total_counts(spark, f"{where}/out", "event_type")


@query("SELECT event_id AS idx, event_type AS response, 1 AS times FROM events")
def stream_annotate(spark, sf_dir):
    """A stream of events whose source repeats every row, in two runs: each index is answered once."""
    where, events = work_dir(spark), prompted(table(spark, sf_dir, "events"), "event_id", "{event_type}")
    for n in range(2):
        events.filter(F.lit(n == 1) | (F.col("idx") % 2 == 0)).write.mode("append").parquet(f"{where}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{where}/in")
        annotate_once(source, echo(), f"{where}/out", f"{where}/checkpoint")
    found = spark.read.parquet(f"{where}/out")
    return found.groupBy("idx", "response").agg(F.count("*").cast("int").alias("times"))


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_round_trip(spark, sf_dir):
    where, labels = work_dir(spark), table(spark, sf_dir, "labels")
    write_jsonl(labels, where, 100)
    return read_jsonl(spark, where, labels.schema)[0]


@query("SELECT CAST(o_orderkey // 256 AS BIGINT) AS batch, count(*) AS rows FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderkey % 401 = 0)")
def batch_alarms(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("valid", F.col("o_orderkey") % 401 == 0)
    return R.batch_alarms(rows, "valid", "o_orderkey", 256)


# Sources, sinks and whole runs.


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr' AND doc_id % 2 = 1")
def split_read(spark, sf_dir):
    """One split of one configuration of a dataset of folders."""
    where = work_dir(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("split"), (F.col("doc_id") % 2).cast("string").alias("config"))
    rows.write.partitionBy("config", "split").parquet(where)
    return load_dataset(spark, where, split="fr", config="1")


def _lines(spark, sf_dir, where: str) -> str:
    """A text file of the nations' prompts with blank lines between them."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("Tell of "), "n_name").alias("value"))
    rows.unionByName(rows.select(F.lit(" ").alias("value"))).coalesce(1).write.text(where)
    return where


@query("SELECT 'Tell of ' || n_name AS prompt FROM nation")
def prompt_file(spark, sf_dir):
    return read_prompts(spark, _lines(spark, sf_dir, work_dir(spark)))


@query("SELECT 2 * count(*) AS lines FROM nation")
def line_count(spark, sf_dir):
    return spark.range(1).select(F.lit(count_lines(spark, _lines(spark, sf_dir, work_dir(spark)))).cast("long").alias("lines"))


@query("""SELECT 'Nations:' || chr(10) || string_agg('- `' || n_name || '`' || CASE WHEN n_nationkey % 2 = 0 THEN ' — number ' || n_nationkey ELSE '' END, chr(10) ORDER BY n_nationkey) AS catalog FROM nation""")
def catalog_file(spark, sf_dir):
    """A catalogue of strings and of entries with a detail, as its file holds it."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    data = {"instruction": "Nations:", "items": [{"name": r.n_name, "detail": f"number {r.n_nationkey}"} if r.n_nationkey % 2 == 0 else r.n_name for r in rows]}
    return spark.createDataFrame([(catalog_text(data),)], "catalog string")


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS removed, (SELECT count(*) FROM documents WHERE lang = 'fr') AS rows_left")
def empty_files_removed(spark, sf_dir):
    """Progress files of which some are empty: one of each source beside those with rows; the rows stay."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents")
    write_jsonl(docs.filter("lang = 'fr'").select("doc_id", "source"), where, 100)
    for r in docs.select("source").distinct().collect():
        write_text(spark, f"{where}/{r.source}.json", "")
    gone = remove_empty_files(spark, where, ".json")
    left = spark.read.schema("doc_id long, source string").json(where)
    return left.agg(F.lit(len(gone)).cast("long").alias("removed"), F.count("*").alias("rows_left"))


@query("SELECT doc_id AS idx, lang, 'Of ' || source AS prompt, 1 AS builds FROM documents")
def prepared_restored(spark, sf_dir):
    """Prepared rows are built by the first call and read back by the second."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents").withColumn("idx", F.col("doc_id"))
    builds = itertools.count()
    hook = lambda df: df if next(builds) >= 0 else df.limit(0)
    for _ in range(2):
        rows = prepare_data(docs, PrepareSpec("Of {source}", keep_columns=("lang",)), where, hook)
    return rows.select("idx", "lang", F.col("messages")[0]["content"].alias("prompt"), F.lit(next(builds)).alias("builds"))


@query("SELECT doc_id AS idx, 'Loud: ' || upper(lang) AS prompt FROM documents")
def preprocess_hook(spark, sf_dir):
    hook = lambda df: df.withColumn("loud", F.upper("lang"))
    rows = prepare(table(spark, sf_dir, "documents").withColumn("idx", F.col("doc_id")).drop("text"), PrepareSpec("Loud: {lang}"), lambda df: hook(df).drop("lang").withColumnRenamed("loud", "lang"))
    return rows.select("idx", F.col("messages")[0]["content"].alias("prompt"))


@query("SELECT 'langs' AS missing, doc_id AS idx, lang AS prompt FROM documents")
def template_check(spark, sf_dir):
    """The column that a template names and the table lacks, from the error's text, and the prompts once it is there."""
    docs = table(spark, sf_dir, "documents").withColumn("idx", F.col("doc_id"))
    try:
        prepare(docs, PrepareSpec("{langs}"))
    except TemplateError as e:
        rows = prepare(docs.withColumnRenamed("lang", str(e).split("'")[1]), PrepareSpec("{langs}"))
        return rows.select(F.lit(str(e).split("'")[1]).alias("missing"), "idx", F.col("messages")[0]["content"].alias("prompt"))
    raise AssertionError("a missing column was not found")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, 'Tag ' || lang AS response, true AS ordered FROM documents")
def annotate_final(spark, sf_dir):
    """The final table of a run as it lies on disk: numbered in order of its files, each row has its own index."""
    where = work_dir(spark)
    annotate_dataset(table(spark, sf_dir, "documents"), where, echo(keep_columns=("doc_id",)), "Tag {lang}", prepare_options={"order_by": ("doc_id",)})
    final = in_source_order(spark.read.parquet(f"{where}/final"), "at")
    return final.select("idx", "doc_id", "response", (F.col("at") == F.col("idx")).alias("ordered"))


@query("SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS idx, doc_id, lang FROM documents")
def source_order(spark, sf_dir):
    """Rows of many files numbered as they lie there, though the first column ties; no row is shuffled for it."""
    where = work_dir(spark)
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id").repartitionByRange(8, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    docs.write.option("maxRecordsPerFile", 40).parquet(where)
    return numbered(spark.read.parquet(where)).select("idx", "doc_id", "lang")


@query("SELECT doc_id AS idx, 'Model b on ' || lang AS response, length(lang) > 5 AS valid FROM documents")
def changed_model_is_not_reused(spark, sf_dir):
    """One folder and template, then another model, then another validator: each is a run of its own."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    model = lambda name, **hooks: AnnotateSpec(ProviderSpec(NamedProvider, name), num_retries_invalid=0, **hooks)
    annotate_dataset(docs, where, model("a"), "{lang}")
    annotate_dataset(docs, where, model("b", validate=lambda row: True), "{lang}")
    found = annotate_dataset(docs, where, model("b", validate=lambda row: len(row["response"]) > len("Model b on ") + 5), "{lang}")
    return found.select("idx", "response", "valid")


class NamedProvider(LastMessageProvider):
    """Answers with the model's name and the message."""

    name = "named"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        return Response(f"Model {self.model} on {messages[-1]['content']}", "stop", None, self.name)


@query("SELECT doc_id AS idx, 'On ' || source AS response, true AS early FROM documents")
def unfinished_run_goes_on(spark, sf_dir):
    """A run that is ended after two of four waves has no final table; the same call later does the rest."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source")
    wave = max(1, docs.count() // 4)
    part = annotate_dataset(docs, where, echo(), "On {source}", wave_rows=wave, max_waves=2)
    early = part.count() < docs.count() and not exists(spark, f"{where}/final")
    return annotate_dataset(docs, where, echo(), "On {source}").select("idx", "response", F.lit(early).alias("early"))


@query("SELECT doc_id AS idx, doc_id::varchar AS response, NULL::varchar AS error, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) AS failed FROM documents")
def retried_errors_replace(spark, sf_dir):
    """Rows that ended in an error are asked again, and the new answers take their place."""
    progress, rows = Progress(spark, work_dir(spark)), prompted(table(spark, sf_dir, "documents"), "doc_id", "{doc_id}")
    failed = run_annotation(rows, AnnotateSpec(ProviderSpec(FailingProvider)), progress).filter("error is not null").count()
    found = run_annotation(rows, echo(), progress, retry_errors=True)
    return found.select("idx", "response", "error", F.lit(failed).cast("long").alias("failed"))


@query("SELECT doc_id AS idx, CASE WHEN doc_id % 8 = 5 THEN 'second' ELSE 'first' END AS response FROM documents")
def broken_job_keeps_its_tasks(spark, sf_dir):
    """A job whose last task dies: what its other tasks had committed counts, and the second run asks for the rest alone."""
    progress, docs = Progress(spark, work_dir(spark)), table(spark, sf_dir, "documents").select("doc_id")
    # Eight tasks of neighbouring indices; the index of a row tells its task.
    n = docs.count()
    rows = prompted(docs.withColumn("at", F.col("doc_id") % 8 * n + F.floor(F.col("doc_id") / 8)), "at", "{doc_id}", keep=("doc_id",))
    dying = AnnotateSpec(ProviderSpec(DyingProvider, "first", {"on_error": "raise"}, extra={}), keep_columns=("doc_id",))
    try:
        run_annotation(rows.filter("doc_id % 8 <> 5"), dying, progress, partitions=8)
        run_annotation(rows, dying, progress, partitions=8)
    except Exception as e:  # noqa: BLE001
        if "dies" not in str(e):
            raise
    found = run_annotation(rows, AnnotateSpec(ProviderSpec(DyingProvider, "second"), keep_columns=("doc_id",)), progress)
    return found.select(F.col("doc_id").alias("idx"), "response")


class DyingProvider(LastMessageProvider):
    """Answers with the model's name; the first model dies at messages whose number is 5 modulo 8."""

    name = "dying"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        if self.model == "first" and int(messages[-1]["content"]) % 8 == 5:
            raise ProviderError("dies")
        return Response(self.model, "stop", None, self.name)


@query("""WITH r AS (SELECT length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents)
SELECT count(*) AS rows, count(*) AS stopped, min(n) AS least, max(n) AS most, true AS percentiles_hold FROM r""")
def merged_statistics(spark, sf_dir):
    """Counts and percentiles of a run of four waves, merged from the waves' own; percentiles are held against the exact ones by rank."""
    progress, docs = Progress(spark, work_dir(spark)), table(spark, sf_dir, "documents")
    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    rows = prompted(docs.select("doc_id", n.alias("n")), "doc_id", "{n}")
    found = run_annotation(rows, AnnotateSpec(ProviderSpec(TokenProvider)), progress, wave_rows=max(1, docs.count() // 4))
    merged = progress.stats()
    total, counts = counted(merged)
    told, every = token_percentiles(merged).first(), found.count()
    below = found.agg(*[F.count_if(F.col("num_tokens") <= told[c]).alias(c) for c in told.__fields__ if c.startswith("p")]).first()
    hold = all(below[f"p{str(p).removesuffix('.0').replace('.', '_')}"] / every >= p / 100 - RANK_ERROR for p in R.PERCENTILES)
    return spark.range(1).select(F.lit(total).cast("long").alias("rows"), F.lit(counts["finish_reason"]["stop"]).cast("long").alias("stopped"), F.lit(told.min).cast("long").alias("least"), F.lit(told.max).cast("long").alias("most"), F.lit(hold).alias("percentiles_hold"))


class TokenProvider(LastMessageProvider):
    """Answers with as many tokens as the message says."""

    name = "tokens"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        return Response("", "stop", None, self.name, int(messages[-1]["content"]))


@query("SELECT doc_id AS idx, 'job ' || lang AS response, 1::BIGINT AS submitted FROM documents")
def batch_jobs(spark, sf_dir):
    """Answers of batch jobs, with how often the ledger says that each row was submitted; the second run submits nothing."""
    progress, rows = Progress(spark, work_dir(spark)), prompted(table(spark, sf_dir, "documents"), "doc_id", "job {lang}")
    spec = AnnotateSpec(ProviderSpec(JobProvider, options={"batch_api": True, "poll_seconds": 0.1}), batch_size=64)
    for _ in range(2):
        found = run_annotation(rows, spec, progress)
    times = Progress(spark, f"{progress.root}/jobs").read().groupBy("idx").agg(F.count("*").alias("submitted"))
    return found.join(times, "idx").select("idx", "response", "submitted")


class JobProvider(LastMessageProvider):
    """A batch service without a server: a job's name holds what was asked."""

    name = "jobs"
    options_class = OpenAIOptions

    def submit(self, batch, options, extra, key: str, look: bool = False) -> str:
        return json.dumps([m[-1]["content"] for m in batch])

    def job_ended(self, name: str) -> bool:
        return True

    def job_results(self, name: str, n: int) -> list[Response]:
        return [Response(said, "stop", None, self.name) for said in json.loads(name)]


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def done_bits(spark, sf_dir):
    """Documents without a label, told by the bits of those that have one: one bit a document in place of a join of rows."""
    path = f"{work_dir(spark)}/bits"
    merged(bitmaps(table(spark, sf_dir, "labels"), "doc_id")).write.parquet(path)
    return skip_set(table(spark, sf_dir, "documents").select("doc_id"), spark.read.parquet(path), "doc_id")


@query("SELECT doc_id AS idx, 'said ' || lang AS said, true AS by_a_server FROM documents")
def leased_places(spark, sf_dir):
    """Tasks of one run share the places at two servers that answer and one that is down."""
    rows = prompted(table(spark, sf_dir, "documents"), "doc_id", "said {lang}")
    spec = AnnotateSpec(ProviderSpec(ServedProvider, base_urls=("down", "slow", "quick")), batch_size=16, queue_size=3)
    found = run_annotation(rows, spec, Progress(spark, work_dir(spark)), partitions=4)
    server, said = F.substring_index("response", ":", 1), F.substring_index("response", ":", -1)
    return found.select("idx", said.alias("said"), server.isin("slow", "quick").alias("by_a_server"))


@query("SELECT item_id, 'Copy ' || item_id AS response FROM benchmark")
def backup_restores(spark, sf_dir):
    """Progress is gone but for its backup, and the model would fail: the answers come from there."""
    where, rows = work_dir(spark), table(spark, sf_dir, "benchmark").select("item_id")
    prompts = prompted(rows, "item_id", "Copy {item_id}", keep=("item_id",))
    run_annotation(prompts, echo(keep_columns=("item_id",)), Progress(spark, f"{where}/a", f"{where}/b"))
    failing = AnnotateSpec(ProviderSpec(FailingProvider, init={"on_error": "raise"}), keep_columns=("item_id",))
    return run_annotation(prompts, failing, Progress(spark, f"{where}/c", f"{where}/b")).select("item_id", "response")


@query("SELECT 'doc_id,response,finish_reason,num_tokens,error,error_type' AS columns, count(*) AS n FROM documents")
def dropped_columns(spark, sf_dir):
    """Index and messages leave the result of a step that keeps neither."""
    where = work_dir(spark)
    found = annotate_dataset(table(spark, sf_dir, "documents").select("doc_id"), where, echo(keep_columns=("doc_id",)), "{doc_id}", keep_idx_column=False).drop("messages")
    return found.select(F.lit(",".join(found.columns)).alias("columns")).groupBy("columns").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS idx, 'old ' || lang AS response FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0")
def older_progress(spark, sf_dir):
    """A run goes on from JSON lines of an older one; the cut last line of a file counts as not done."""
    where, docs = work_dir(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    old = docs.filter("idx % 5 > 0").select("idx", F.concat(F.lit("old "), "lang").alias("response"))
    write_jsonl(old, f"{where}/old", 50)
    for name, _ in list_files(spark, f"{where}/old", ".json"):
        write_text(spark, name.removesuffix(".json") + ".jsonl", read_text(spark, name) + '{"idx": 0, "respon')
    return annotate_dataset(docs, where, echo(), "new", import_from=f"{where}/old").select("idx", "response")


@query("SELECT 'Fact on ' || n_name AS response FROM nation")
def generate_list(spark, sf_dir):
    """One answer to each prompt of a list."""
    prompts = [r[0] for r in table(spark, sf_dir, "nation").select(F.concat(F.lit("Fact on "), "n_name")).collect()]
    return generate_dataset(spark, prompts, work_dir(spark), echo()).select("response")


def _pipeline(spark, sf_dir, where: str, **more) -> PipelineConfig:
    steps = [{"name": "one", "prompt": "One {text}", "rename": {"one_response": "said"}}, {"name": "two", "prompt": "Two {said}", "keep_messages": True}]
    return PipelineConfig(where, steps, DatasetConfig(path=f"{sf_dir}/benchmark.parquet"), {"provider": "echo"}, **more)


@query("SELECT item_id, 'One ' || text AS said FROM benchmark")
def step_snapshot(spark, sf_dir):
    """What the first step left behind, after the second ran over it."""
    config = _pipeline(spark, sf_dir, work_dir(spark))
    run_pipeline(spark, config)
    return spark.read.parquet(f"{config.step_dir(0)}/output").select("item_id", "said")


@query("SELECT item_id, 'Two One ' || text AS two_response, 'Two One ' || text AS asked FROM benchmark")
def resumed_step(spark, sf_dir):
    """The second step alone, over the first one's snapshot of an earlier run; copied to the pipeline's backup."""
    where = work_dir(spark)
    run_pipeline(spark, _pipeline(spark, sf_dir, where), ["one"])
    run_pipeline(spark, _pipeline(spark, sf_dir, where, backup=f"{where}/copy"), ["two"])
    return spark.read.parquet(f"{where}/copy").select("item_id", "two_response", F.element_at("two_messages", -1)["content"].alias("asked"))


@query("SELECT 'one' AS name, 'One {text}' AS prompt, 'echo' AS provider UNION ALL SELECT 'two', 'Two {said}', 'echo'")
def resolved_config(spark, sf_dir):
    """The configuration that a run wrote beside its steps."""
    where = work_dir(spark)
    run_pipeline(spark, _pipeline(spark, sf_dir, where))
    told = spark.read.option("multiLine", "true").json(f"{where}/pipeline.json")
    return told.select(F.explode("steps").alias("s"), "client.provider").select("s.name", "s.prompt", "provider")


@query("SELECT count(*) AS num_rows, count(*) AS stopped FROM documents")
def metadata_file(spark, sf_dir):
    where = work_dir(spark)
    annotate_dataset(table(spark, sf_dir, "documents").select("doc_id", "lang"), where, echo(), "{lang}")
    return spark.read.option("multiLine", "true").json(f"{where}/metadata.json").select("num_rows", F.col("counts.finish_reason.stop").alias("stopped"))


class WarmedProvider(LastMessageProvider):
    """Answers with what it was warmed up with, and how often."""

    name = "warmed"

    def __init__(self, model: str = "", **kwargs):
        super().__init__(model, **kwargs)
        self.warm: list[str] = []

    def warm_up(self, prefix, system, options) -> None:
        self.warm.append(f"{system}/{prefix}")

    def generate(self, messages: Messages, options: RuntimeOptions, **extra) -> Response:
        return Response("+".join(self.warm), "stop", None, self.name)


@query(f"SELECT doc_id, '{SYSTEM}/Label ' AS response FROM documents")
def warm_up(spark, sf_dir):
    """Each task warms its provider up once, with the prompts' common beginning."""
    spec = AnnotateSpec(ProviderSpec(WarmedProvider), keep_columns=("doc_id",), batch_size=16)
    return annotate_dataset(table(spark, sf_dir, "documents"), work_dir(spark), spec, "Label {lang}", system=SYSTEM).select("doc_id", "response")


@query("SELECT conv_id, turn, trim(coalesce(text, '') || chr(10) || role) AS said FROM conversations WHERE text IS NOT NULL")
def text_blocks(spark, sf_dir):
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", S.join_text_blocks(F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.col("role")))).alias("said"))


@query("SELECT doc_id, 'content_quality::' || lang AS content_quality, 'one_sentence_description::' || lang AS one_sentence_description, 18 AS n FROM documents")
def document_properties(spark, sf_dir):
    """Documents annotated with the schema of all properties."""
    spec = AnnotateSpec(ProviderSpec("echo"), property_schema(), keep_columns=("doc_id",), num_retries_invalid=0)
    found = annotate(prompted(table(spark, sf_dir, "documents"), "doc_id", "{lang}", keep=("doc_id",)), spec)
    return found.select("doc_id", "content_quality", "one_sentence_description", F.lit(sum(c in found.columns for c in PROPERTIES)).alias("n"))


@query("SELECT doc_id AS idx, 'A ' || lang AS response, 'train' AS dataset_split FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'B ' || lang, 'test' FROM documents WHERE doc_id % 2 = 1")
def split_progress(spark, sf_dir):
    """Progress of one split does not count for another one's rows of the same index."""
    progress, docs = Progress(spark, work_dir(spark)), table(spark, sf_dir, "documents")
    run_annotation(prompted(docs, "doc_id", "A {lang}"), echo(), progress, dataset_split="train")
    test = run_annotation(prompted(docs.filter("doc_id % 2 = 1"), "doc_id", "B {lang}"), echo(), progress, dataset_split="test")
    train = run_annotation(prompted(docs, "doc_id", "C {lang}"), echo(), progress, dataset_split="train").filter("idx % 2 = 0")
    return train.select("idx", "response", F.lit("train").alias("dataset_split")).unionByName(test.select("idx", "response", F.lit("test").alias("dataset_split")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents prompted, answered by the echo provider, committed and read back in order."""
    docs = table(spark, sf_dir, "documents")
    rows = prepare(docs, PrepareSpec("Classify: {text}", SYSTEM, order_by=("doc_id",), keep_columns=("doc_id", "lang")))
    return run_annotation(rows, echo(output_schema=LABEL_SCHEMA, keep_columns=("doc_id", "lang")), Progress(spark, work_dir(spark)))

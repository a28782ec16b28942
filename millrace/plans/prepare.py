"""From a source table to rendered prompts: index, shuffle, limit, render, sort, prune."""

from __future__ import annotations

import contextlib
import hashlib
import json
import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.identity import code_mark
from millrace.functions.scalar import prompt_length
from millrace.plans.source_order import in_source_order
from millrace.plans.template import PromptTemplate, messages
from millrace.sources.tables import exists, read_text, write_text

log = logging.getLogger("millrace.prepare")
#: Ranges that ``assign_index`` numbers in parallel, at least and at most (as many as shuffle partitions in between), and sampled keys for each bound.
LEAST_RANGES, MOST_RANGES, KEYS_PER_BOUND = 64, 512, 32
#: Column of prepared rows that are sorted by length: the key that they are in order of.
LENGTH_KEY = "__length_key"


def key_ranges(df: DataFrame, keys: list[str]) -> Column:
    """Number of the range that a row's key lies in.

    The bounds are literals taken from a bounded sample of keys (those of smallest hash),
    so every evaluation of the plan deals rows alike.
    """
    ranges = min(MOST_RANGES, max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(ranges * KEYS_PER_BOUND).orderBy(*keys).collect()
    kinds = [df.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, row, kinds)]) for row in sample[KEYS_PER_BOUND::KEYS_PER_BOUND]]
    if not bounds:
        return F.lit(0)
    # The key is bound to a variable, so what it is computed from is not computed once a bound.
    return F.transform(F.array(F.struct(*keys)), lambda key: F.size(F.filter(F.array(*bounds), lambda b: b <= key)))[0]


def assign_index(df: DataFrame, order_by: Iterable[str], name: str = "idx") -> DataFrame:
    """0, 1, 2... in the order of the given columns, which must tell rows apart.

    Rows are dealt by range and numbered within each; only the number of rows of each
    range is gathered, so no single task sorts the table.
    """
    keys = list(order_by)
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    dealt = df.withColumn("__part", key_ranges(df, keys))
    sizes = {r["__part"]: r.n for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for p, n in sizes.items() if p < k) for k in range(max(sizes, default=0) + 1)]
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)).cast("long")
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__part") + 1)
    return dealt.withColumn(name, start + within - 1).select(name, *df.columns)


def shuffle_key(key: str, seed: int):
    """A value that orders rows at random, the same way for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)


def limited(df: DataFrame, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("the number of samples must be positive")
    return df.limit(n)


@dataclass(frozen=True)
class PrepareSpec:
    """What turns a source table into prompts."""

    template: str
    system: str | None = None
    task_prefix: str = ""
    idx_column: str = "idx"
    order_by: tuple[str, ...] = ()
    swap_fields: tuple[tuple[str, str], ...] = ()
    shuffle_seed: int | None = None
    max_samples: int | None = None
    keep_columns: tuple[str, ...] | bool = ()
    #: False, True or "longest_first", or "shortest_first".
    sort_by_length: bool | str = False
    #: Tasks that prepare rows, at most; all by default.
    num_proc: int | None = None

    def parsed(self) -> PromptTemplate:
        return PromptTemplate.parse(self.template).swapped(dict(self.swap_fields))

    def fingerprint(self, df: DataFrame, preprocess: Callable | None = None, version: str | None = None) -> str:
        """Changes with the spec, the hook's code and what ``df`` reads; the same in every session.

        ``version`` names the source's state in place of what is found out about it.
        """
        spec = {k: v for k, v in asdict(self).items() if k != "num_proc"}
        source = version if version is not None else source_state(df)
        return hashlib.sha256(json.dumps([spec, code_mark(preprocess), df.schema.json(), source], sort_keys=True, default=str).encode()).hexdigest()


#: Plan nodes whose content is told by their text.
_TOLD = ("Range", "OneRowRelation")
_IDS = re.compile(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]|@[0-9a-f]{5,}")


@contextlib.contextmanager
def _whole_plans(spark: SparkSession):
    """Plans are written without leaving columns out."""
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def source_state(df: DataFrame) -> list:
    """What tells a table's content: its plan without the numbers of a session, and its files with length and time of change.

    A table that is not read from files alone is told by a hash of its rows as well. Files
    are listed and hashed by a Spark job.
    """
    spark = df.sparkSession
    with _whole_plans(spark):
        analyzed = df._jdf.queryExecution().analyzed()
        plan = _IDS.sub("", analyzed.canonicalized().toString())
        leaves = analyzed.collectLeaves()
        kinds = {leaves.apply(k).getClass().getSimpleName() for k in range(leaves.size())}
    state: list = [plan]
    files = df.inputFiles() if kinds - set(_TOLD) else []
    if files:
        listed = spark.read.format("binaryFile").load(files)
        one = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
        state += list(listed.agg(F.count("*"), F.sum("length"), F.bit_xor(one)).first())
    if kinds - {"LogicalRelation", "DataSourceV2Relation", "HiveTableRelation", "SubqueryAlias", *_TOLD}:
        one = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        state += list(df.agg(F.count("*"), F.bit_xor(one), F.sum(one.cast("decimal(38,0)")).cast("string")).first())
    return state


def numbered(df: DataFrame, order_by: tuple[str, ...] = (), name: str = "idx") -> DataFrame:
    """Rows with an index: in the given order, else in the source's own; by first column and content where a plan has none."""
    if order_by:
        return assign_index(df, order_by, name)
    if (found := in_source_order(df, name)) is not None:
        return found
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return assign_index(df.withColumn("__content", content), [df.columns[0], "__content"], name).drop("__content")


def prepare(df: DataFrame, spec: PrepareSpec, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lazy plan of idx, kept columns and messages.

    Rows are indexed in source order before the shuffle, and the limit is taken before
    the hook and the rendering, so nothing is rendered that is not kept.
    """
    template, prefix = spec.parsed(), spec.task_prefix
    if spec.idx_column not in df.columns:
        df = numbered(df, spec.order_by, spec.idx_column)
    elif spec.order_by:
        raise ValueError(f"column {spec.idx_column!r} exists already")
    if spec.shuffle_seed is not None:
        df = shuffled(df, spec.idx_column, spec.shuffle_seed)
    elif spec.max_samples is not None:
        df = df.orderBy(spec.idx_column)
    if spec.max_samples is not None:
        df = limited(df, spec.max_samples)
    template.check(df)
    if preprocess is not None:
        df = df.transform(preprocess)
    if spec.num_proc:
        df = df.coalesce(spec.num_proc)
    df = df.withColumn(f"{prefix}messages", messages(template.column(df), spec.system))
    kept = [c for c in df.columns if c != f"{prefix}messages" and (spec.keep_columns is True or c == spec.idx_column or c in (spec.keep_columns or ()))]
    df = df.select(*kept, f"{prefix}messages")
    if spec.sort_by_length:
        # The key stays with the prepared rows, so that waves and batches follow it.
        length = prompt_length(F.col(f"{prefix}messages")).cast("long")
        df = df.withColumn(LENGTH_KEY, length if spec.sort_by_length == "shortest_first" else -length).orderBy(LENGTH_KEY, spec.idx_column)
    return df


def prepare_data(df: DataFrame, spec: PrepareSpec, path: str, preprocess=None, force: bool = False, backup: str | None = None, mark: str | None = None) -> DataFrame:
    """Prepared prompts, written once: read from ``path``, else from ``backup``, else built.

    Each copy carries a fingerprint (``mark``); one that was made otherwise is built anew.
    """
    spark, mark = df.sparkSession, mark or spec.fingerprint(df, preprocess)
    for place in [] if force else [path, backup]:
        if place and exists(spark, f"{place}/data/_SUCCESS"):
            if read_text(spark, f"{place}/fingerprint") == mark:
                return spark.read.parquet(f"{place}/data")
            log.warning("prepared data at %s were made from another source or template; they are built anew", place)
    built = prepare(df, spec, preprocess)
    for place in filter(None, [path, backup]):
        built.write.mode("overwrite").parquet(f"{place}/data")
        write_text(spark, f"{place}/fingerprint", mark)
        built = spark.read.parquet(f"{path}/data")
    return built


def generated(spark: SparkSession, prompts: str | list[str], n: int | None = None) -> DataFrame:
    """Rows (idx, prompt) to generate from: one prompt n times (once by default), or each of a list."""
    if isinstance(prompts, str):
        if n is not None and n < 1:
            raise ValueError("the number of samples must be positive")
        return spark.range(n or 1).select(F.col("id").alias("idx"), F.lit(prompts).alias("prompt"))
    if not prompts:
        raise ValueError("no prompts were given")
    return spark.createDataFrame(list(enumerate(prompts)), "idx long, prompt string")

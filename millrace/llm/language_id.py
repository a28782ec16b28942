"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log probabilities for each language:

* text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of
  labelled rows and applied to whole texts. The sum over a text is scaled down to
  ``EFFECTIVE_GRAMS`` independent grams, as neighbouring trigrams are not independent;
* the language that the markup declares, by a confusion table counted over all rows. The
  label that the text model is fitted on is never passed as a declaration;
* the address suffix, where the host has one, as the middle level of the prior;
* the host, by a prior that is smoothed towards its suffix and that towards the whole
  corpus. All three levels are grouped sums of text posteriors over every row.

A document is rejected when its text holds no letters, or when an even spread over
letters explains the text better than every language does. Everything else is kept
with its most probable language.

Defined cases: a null or empty text has no letters and is rejected; null markup, host
or suffix give no evidence of their own (null hosts share one prior); ties go to the
language first by name; repeated rows are judged alike; an empty table gives an empty
result; extra columns are not read. Documents have no markup, and their sources have no
suffix: text and source decide there. Pages have all four kinds (``page_rows``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .remembered import forget
from .skew import spread_join
from .staging import fresh_name, stage

#: Texts of each language that the text model is fitted on, at most: those with the smallest hash.
SAMPLE_ROWS = 400
#: Languages that are fitted, at most: the most frequent labels. This bounds the sample that the driver reads.
MAX_LANGUAGES = 100
#: Characters of a sampled row that the fit reads, at most; this bounds the sample, scoring reads whole texts.
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
EFFECTIVE_GRAMS = 60.0
#: Rows of its parent that count as much as a host's own rows.
SMOOTHING = 20.0
#: Log odds that text in no known language starts with.
UNKNOWN_PRIOR = -4.0
#: The first language of the html element, without its region; the host of an address, without user, port and last dot.
_DECLARED = r"(?is)<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]+)"
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?:[:/?#]|\s*$)"
_UNSEEN = re.compile(r"<!--.*?(?:-->|(?P<open>\Z))|<(?P<name>script|style)\b.*?(?:</(?P=name)\s*>|(?P<unended>\Z))|</?[A-Za-z!?][^>]*>", re.S | re.I)
_UNENDED = re.compile(r"<!--|<(?:script|style)\b", re.I)


def seen_text(page: str) -> str:
    """Text of a page without tags, comments and scripts, in linear time.

    No tag is closed behind the last ``>``, so none is looked for there; a comment or script
    that nothing ends reaches to the end of the page.
    """
    last = page.rfind(">") + 1
    head, tail, reached = page[:last], page[last:], False

    def blank(m: re.Match) -> str:
        nonlocal reached
        reached = m["open"] is not None or m["unended"] is not None
        return " "

    head = _UNSEEN.sub(blank, head)
    if reached:
        return html.unescape(head)
    cut = _UNENDED.search(tail)
    return html.unescape(head + (f"{tail[: cut.start()]} " if cut else tail))


_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_PLAIN = np.where(_LETTER, _LOWER, ord(" ")).astype(np.uint8)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with letters in lower case and the rest blank, and where each text ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return _PLAIN[data], ends - ends[0]


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether it holds two letters at least."""
    x = data.astype(np.uint32)
    mix = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    blank = data == 32
    return (mix >> np.uint32(16)).astype(np.uint16), (blank[:-2].astype(np.uint8) + blank[1:-1] + blank[2:]) <= 1


def fit(sample: dict[str, list[str]]) -> tuple[list[str], np.ndarray]:
    """Languages by name and log probabilities [language, bucket]; the last row is the even spread."""
    names = sorted(sample)
    tables = np.zeros((len(names) + 1, BUCKETS))
    for k, name in enumerate(names):
        data, ends = _flat(pa.array(sample[name], pa.string()))
        for a, b in zip(ends, ends[1:]):
            if b - a > 2:
                gram, good = _grams(data[a:b])
                tables[k] += np.bincount(gram[good], minlength=BUCKETS)
    seen = tables[:-1].sum(0) > 0
    tables[:-1] += 0.05
    tables[-1] = 1.0
    # The even spread covers the grams of any language four times over: text must look like one to beat it.
    tables /= tables.sum(1, keepdims=True)
    tables[-1] = 1.0 / max(1, 4 * int(seen.sum()))
    return names, np.log(tables).astype(np.float32)


def text_scores(table: np.ndarray):
    """Function for ``mapInArrow``: rows with a text column last to those rows with ``grams`` and ``scores`` instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            data, ends = _flat(batch.column(batch.num_columns - 1))
            counts = np.zeros(batch.num_rows)
            sums = np.zeros((batch.num_rows, len(table)))
            for first in range(0, batch.num_rows, 256):
                last = min(first + 256, batch.num_rows)
                part = data[ends[first] : ends[last]]
                if len(part) < 3:
                    continue
                gram, good = _grams(part)
                # A gram belongs to the text that it lies in; those across two texts do not count.
                starts, stops = ends[first:last] - ends[first], np.maximum(ends[first + 1 : last + 1] - ends[first] - 2, ends[first:last] - ends[first])
                good = np.append(good, False)
                across = np.unique(np.concatenate([stops, stops + 1]))
                good[across[across < len(good)]] = False
                starts, stops = np.minimum(starts, len(gram)), np.minimum(stops, len(gram))
                run_of = lambda x: np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
                n = run_of(good[:-1])
                counts[first:last] = n[stops] - n[starts]
                for k, row in enumerate(table):
                    s = run_of(np.where(good[:-1], row[gram], np.float32(0)))
                    sums[first:last, k] = s[stops] - s[starts]
            scores = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(table), dtype=np.int32), pa.array(sums.ravel()))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), scores], [*batch.schema.names[:-1], "grams", "scores"])

    return run


def visible_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with html last to those with the ``text`` that it shows: no comments, scripts, styles and tags; references resolved."""
    for batch in batches:
        pages = batch.column(batch.num_columns - 1).to_pylist()
        text = pa.array([None if p is None else seen_text(p) for p in pages], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], [*batch.schema.names[:-1], "text"])


def page_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, host, text) of pages (page_id, url, html)."""
    found = lambda column, pattern: F.lower(F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")))
    read = pages.select(F.col("page_id").alias("doc_id"), found("html", _DECLARED).alias("declared"), found("url", _HOST).alias("host"), "html")
    return read.mapInArrow(visible_text, "doc_id long, declared string, host string, text string")


def sample_rows(docs: DataFrame, label: str) -> dict[str, list[str]]:
    """Bounded sample of labelled texts: ``SAMPLE_ROWS`` distinct texts a language, those with the smallest hash of the text.

    Of more than ``MAX_LANGUAGES`` labels the most frequent ones are fitted; the others are no languages of the model.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label"), F.xxhash64("text").alias("h"), "text")
    # Distinct hashes are counted, so that copies of one text neither fill the sample nor thin it out.
    counts = rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    # Hashes are spread evenly, so this threshold leaves a few times the wanted texts of each language.
    limits = docs.sparkSession.createDataFrame([(r.label, min(1.0, 3.0 * SAMPLE_ROWS / max(1, r.n))) for r in counts], "label string, limit double")
    near = rows.join(F.broadcast(limits), "label").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("limit"))
    texts = near.groupBy("label", "h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    best = texts.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("rank") <= SAMPLE_ROWS)
    found: dict[str, list[str]] = {}
    for r in best.orderBy("label", "rank").select("label", "text").collect():
        found.setdefault(r.label, []).append(r.text)
    return found


def _log_sum(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def _normal(x: Column) -> Column:
    """Probabilities of log weights."""
    total = _log_sum(x)
    return F.transform(x, lambda v: F.exp(v - total))


def _sums(n: int, column: str) -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(n)])


def _smoothed(own: str, parent: Column, n: int) -> Column:
    """Share of each language among own rows and ``SMOOTHING`` rows spread as the parent's."""
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v) + F.lit(SMOOTHING)
    return F.array(*[(F.col(own)[k] + F.lit(SMOOTHING) * parent[k]) / total for k in range(n)])


def identify(docs: DataFrame, label: str = "lang", declared: str | None = None, host: str | None = "source", carry: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Evidence and decision for each row: doc_id, carried columns, language, confidence, kept. The text model is fitted on ``labelled``, or else on ``docs``."""
    sample = sample_rows(docs if labelled is None else labelled, label)
    carry = carry or []
    # Carried columns travel under names of their own, so theirs may be any.
    own = [f"carried_{k}" for k in range(len(carry))]
    back = [F.col(o).alias(c) for o, c in zip(own, carry)]
    if not sample:
        return docs.select("doc_id", *carry, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    names, table = fit(sample)
    n = len(names)
    null = F.lit(None).cast("string")
    host_of = F.lower(F.col(host)) if host else null
    read = docs.select("doc_id", *[F.col(c).alias(o) for c, o in zip(carry, own)], (F.col(declared) if declared else null).alias("declared"), host_of.alias("host"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: 1 + len(own)])
    scored = read.mapInArrow(text_scores(table), f"{fields}, declared string, host string, grams double, scores array<double>")
    scale = F.least(F.lit(1.0), F.lit(EFFECTIVE_GRAMS) / F.greatest(F.col("grams"), F.lit(1.0)))
    # The part of a name after its last dot; hosts without a dot and numeric addresses have no suffix.
    suffix = F.nullif(F.regexp_extract("host", r"\.([^.0-9][^.]*)$", 1), F.lit(""))
    scored = scored.select("doc_id", *own, "declared", "host", suffix.alias("suffix"), "grams", F.transform("scores", lambda v: v * scale).alias("logs"), F.monotonically_increasing_id().alias("row"))
    scored = scored.withColumn("text_p", _normal(F.slice("logs", 1, n)))
    scored = stage(scored.withColumn("seen", F.when(F.col("grams") > 0, F.col("text_p")).otherwise(F.array(*[F.lit(0.0)] * n))), "language-scores")

    hosts = stage(scored.groupBy("host", "suffix").agg(_sums(n, "seen").alias("own"), F.count("*").alias("n_rows")), "hosts")
    suffixes = hosts.groupBy("suffix").agg(_sums(n, "own").alias("of_suffix"))
    corpus = [x or 0.0 for x in (suffixes.agg(_sums(n, "of_suffix").alias("x")).first().x or [0.0] * n)]
    whole = F.array(*[F.lit((x + 1.0) / (sum(corpus) + n)) for x in corpus])
    suffixes = suffixes.select(F.col("suffix").alias("__suffix"), _smoothed("of_suffix", whole, n).alias("suffix_p"))
    priors = hosts.join(suffixes, hosts["suffix"].eqNullSafe(suffixes["__suffix"])).select("host", F.transform(_smoothed("own", F.col("suffix_p"), n), lambda p: F.log(p)).alias("prior"), "n_rows")
    priors = stage(priors, "host-priors")

    # How often each declaration goes with each language, by the text alone; its values are the declared strings.
    said = scored.filter("declared is not null and grams > 0").groupBy("declared").agg(_sums(n, "seen").alias("with"))
    per = [F.lit(max(x, 1e-9)) for x in corpus]
    said = stage(said.select(F.col("declared").alias("__declared"), F.array(*[F.log((F.col("with")[k] + 0.5) / (per[k] + 1.0)) for k in range(n)]).alias("declares")), "declarations")

    met = spread_join(scored, priors, ["host"], "n_rows", ["row"], null_safe=True)
    met = met.join(said, met["declared"] == said["__declared"], "left")
    unsaid = F.array(*[F.lit(0.0)] * n)
    total = F.zip_with(F.zip_with(F.slice("logs", 1, n), F.col("prior"), lambda a, b: a + b), F.coalesce(F.col("declares"), unsaid), lambda a, b: a + b)
    met = met.withColumn("total", total).withColumn("posterior", _normal(F.col("total")))
    best = F.array_max("posterior")
    language = F.array(*[F.lit(x) for x in names])[(F.array_position("posterior", best) - 1).cast("int")]
    known = F.array_max(F.slice("logs", 1, n)) >= F.col("logs")[n] + F.lit(UNKNOWN_PRIOR)
    kept = (F.col("grams") > 0) & known
    return met.select("doc_id", *back, language.alias("language"), best.alias("confidence"), kept.alias("kept"))


def drop_unknown(docs: DataFrame) -> DataFrame:
    """Documents in a known language, with their columns. The text alone rejects, so rows of one text go or stay together, with and without an id."""
    name = fresh_name(docs, "hash")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    decided = identify(keyed, carry=[name])
    rejected = stage(decided.filter(~F.col("kept")).select("doc_id", name).distinct(), "rejected").hint("merge")
    return keyed.join(rejected, keyed["doc_id"].eqNullSafe(rejected["doc_id"]) & (keyed[name] == rejected[name]), "left_anti").drop(name)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["lang", "source"])


def op10_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four kinds of evidence; the text model is fitted on labelled documents."""
    pages, documents = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    rows = page_rows(pages).withColumns({"declared_language": F.col("declared"), "page_host": F.col("host")})
    found = identify(rows, declared="declared", host="host", carry=["declared_language", "page_host"], labelled=documents)
    return found.withColumnRenamed("doc_id", "page_id")

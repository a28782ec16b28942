"""Quality of texts, learnt from trusted positives and unlabelled texts alone.

Nobody has to say what is bad. Texts that are known to be good (``quality`` 1) are compared with
texts of which nothing is known. The share of good ones among the latter, the class prior, is
estimated from the scores of a first classifier: among the best scored texts nearly all are good,
so the prior is the least ratio of the unlabelled texts' share above a score to the positives'
share above it, with a margin for chance. The classifier then minimises the non-negative
unbiased risk: the risk on negatives is that of the unlabelled texts less the prior's part of
good ones, and where a batch makes it negative, which is overfitting, that step goes back up.

A text is described by its kinds of bytes (letters, digits, each mark) in pairs, by how
often words and neighbouring words repeat, and by the lengths of its words and lines: never by
its id, source, language or labels. Texts are described where they lie. The fit sees
``POSITIVES`` and ``UNLABELLED`` different texts at most, those of smallest hash among the rows
that are not held out; everything else reads all rows.

Defined cases: a null text is empty, and an empty one is scored like any other; long texts
are read whole; equal texts get equal scores, and count once in the fit; a row that repeats
is scored each time; rows without an id are scored and belong to the unlabelled; an id with
labels that differ, or with a null one, is no trusted positive; without positives every text gets the
prior 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import WordHashes, mixed

#: Different texts that the fit sees, at most.
POSITIVES, UNLABELLED = 3000, 6000
#: Steps of the fit, texts of each kind in one, step size, weight decay and the size of a step back.
STEPS, BATCH, RATE, DECAY, BACK = 900, 256, 0.01, 1e-4, 1.0
#: Chance of a wrong margin in the estimate of the prior.
DELTA = 0.1
SEED = 17

#: Marks that are kinds of bytes of their own.
MARKS = b".,;:!?'\"-()#&$*%|@/_=+<>"
KINDS = 32


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 other, then letters, digits, blanks, ends of lines, parts of longer characters, marks."""
    kind = np.zeros(256, np.int16)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    kind[[32, 9]], kind[[10, 13]], kind[128:192], kind[192:] = 4, 5, 6, 7
    kind[list(MARKS)] = np.arange(8, 8 + len(MARKS)) % KINDS
    return kind


_KIND = _kinds()
#: Numbers that describe a text.
WIDTH = KINDS * KINDS + 10
#: Bytes of a text whose pairs are counted at a time.
SLICE = 1 << 22


def described(text: str, hashes: WordHashes) -> np.ndarray:
    """The numbers of one text: root shares of pairs of kinds, then repetition and lengths."""
    data = text.encode("utf-8", "surrogatepass")
    pairs = np.zeros(KINDS * KINDS)
    for at in range(0, max(len(data) - 1, 0), SLICE):
        kind = _KIND[np.frombuffer(data, np.uint8, min(SLICE + 1, len(data) - at), at)]
        pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
    out = np.zeros(WIDTH, np.float32)
    out[: KINDS * KINDS] = np.sqrt(pairs / max(1.0, pairs.sum()))
    words = hashes.of(data.split())
    n = len(words)
    lines = data.count(b"\n") + 1
    if n:
        _, times = np.unique(words, return_counts=True)
        twos = np.unique(mixed(words[:-1]) + words[1:])
        top = np.sort(times)[::-1]
        out[KINDS * KINDS :] = (
            len(times) / n, top[0] / n, top[:5].sum() / n, (words[1:] == words[:-1]).mean() if n > 1 else 0.0, len(twos) / max(1, n - 1),
            np.log(len(times) + 1) / np.log(n + 1), np.log1p(n), np.log1p(len(data) / n), np.log1p(n / lines), n == 1,
        )
    return out


def describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches whose last column is a text, each with its texts' numbers, a slice of 512 rows at a time."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(part.num_columns - 1).to_pylist()
            yield part, np.stack([described(t or "", hashes) for t in texts])


def log_loss_slope(margin: np.ndarray) -> np.ndarray:
    """Slope of ``log(1 + exp(-margin))``."""
    return -1.0 / (1.0 + np.exp(np.clip(margin, -50, 50)))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x).astype(np.float64), -50, 50)))


def minimised(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of least risk, by Adam, averaged over the second half of the steps.

    With a prior the risk is the non-negative unbiased one; without, unlabelled texts count as negatives.
    """
    rng, width = np.random.default_rng(seed), positive.shape[1]
    theta, mean, square, kept = (np.zeros(width + 1, np.float32) for _ in range(4))

    def slope(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(by @ x, by.sum()) / np.float32(len(x))

    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(BATCH, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(2 * BATCH, len(unlabelled)))]
        at_p, at_u = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        as_negative = -slope(u, log_loss_slope(-at_u))
        if prior is None:
            change = slope(p, log_loss_slope(at_p)) + as_negative
        else:
            as_negative = as_negative + np.float32(prior) * slope(p, log_loss_slope(-at_p))
            risk = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
            change = np.float32(prior) * slope(p, log_loss_slope(at_p)) + as_negative if risk >= 0 else -np.float32(BACK) * as_negative
        change[:-1] += np.float32(DECAY) * theta[:-1]
        mean, square = np.float32(0.9) * mean + np.float32(0.1) * change, np.float32(0.999) * square + np.float32(0.001) * change * change
        rate = np.float32(RATE * min(1.0, 2.0 * (1 - step / (steps + 1))) / (1 - 0.9**step))
        theta = theta - rate * mean / (np.sqrt(square / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        if 2 * step > steps:
            kept += theta
    kept /= max(1, steps - steps // 2)
    return kept[:-1], float(kept[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = DELTA) -> float:
    """Share of positives among unlabelled scores: the least ratio of the two shares above a score, chosen with a margin."""
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    chance = np.sqrt(np.log(4 / delta) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((above_u + 1.01 * chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> QualityModel | None:
    """Standardise, estimate the prior on halves that did not fit, then minimise the risk on all. None without examples."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    # Numbers that are the same in all unlabelled texts say nothing.
    told = np.flatnonzero(unlabelled.std(0) > 0)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 0.01 * unlabelled.std() + 1e-6
    p, u = (((x - centre) / scale)[:, told].astype(np.float32) for x in (positive, unlabelled))
    scores: tuple[list, list] = ([], [])
    for k in (0, 1):  # each half is scored by the other's classifier
        w, b = minimised(p[k::2], u[k::2], None, STEPS // 3, seed + k)
        scores[0].append(p[1 - k :: 2] @ w + b)
        scores[1].append(u[1 - k :: 2] @ w + b)
    prior = float(np.mean([class_prior(a, b) for a, b in zip(*scores)]))
    w, b = minimised(p, u, prior, STEPS, seed)
    weights = np.zeros(positive.shape[1], np.float32)
    weights[told] = w
    return QualityModel(weights, b, centre.astype(np.float32), scale.astype(np.float32), prior)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(texts: DataFrame, most: int, salt: int) -> DataFrame:
    """(hash) of so many different texts at most, those of smallest salted hash."""
    return texts.select("hash").distinct().orderBy(F.xxhash64("hash", F.lit(salt)), "hash").limit(most)


def gathered(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts to fit on: trusted positives and unlabelled ones, each text once.

    What comes to the driver is one vector of ``WIDTH`` floats for each of the sampled texts.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64("text"))
    trusted = labels.groupBy("doc_id").agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good")).filter("good").select("doc_id")
    good = sampled(texts.select("doc_id", "hash").join(trusted, "doc_id", "left_semi"), positives, 1).select("hash", F.lit(True).alias("good"))
    some = sampled(texts, unlabelled, 2).select("hash", F.lit(False).alias("good"))
    # Of bounded size: so many hashes as there are texts in the sample.
    picked = good.unionByName(some).groupBy("hash").agg(F.max("good").alias("good"), F.min("good").alias("both"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in describe_batches(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], [*part.schema.names[:-1], "numbers"])

    rows = texts.join(F.broadcast(picked), "hash").select("hash", "good", "both", "text").dropDuplicates(["hash"])
    found = rows.mapInArrow(run, "hash long, good boolean, both boolean, numbers binary").toArrow().sort_by("hash")
    x = np.frombuffer(b"".join(found.column("numbers").to_pylist()), np.float32).reshape(-1, WIDTH)
    good_rows, both = (found.column(c).to_numpy().astype(bool) for c in ("good", "both"))
    return x[good_rows], x[~good_rows | ~both]


def score_texts(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, 0.5))], ["doc_id", "score"])
            return
        for part, x in describe_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_texts(docs, fit_quality(*gathered(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

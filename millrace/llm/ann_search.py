"""Approximate nearest neighbours by adaptive dimension scans in probed lists.

Largest inner products are smallest distances once every vector gets one more
component that brings it to the largest norm; queries get a zero there. Vectors are
then turned by a random rotation, so that the first components of a difference are a
fair sample of it. They lie in lists around centroids fitted on a bounded sample, in two
levels: cells, and the lists of each cell. There are about as many lists as the root of
the number of rows, so lists and what is compared with centroids grow alike. A list lies
in blocks of columns. A scan adds up one block of columns after another,
and after each a hypothesis test on the partial distance abandons candidates that can
hardly beat the best found so far. Survivors are scored in double precision on the
original vectors.

The number of lists probed is the smallest that finds ``RECALL`` of the true
neighbours of sampled queries among the sample. Neighbouring lists form units of about
``BLOCK_ROWS`` rows, and a longer list is split into several, so no list is one task's
work and a query is sent once to each unit that it probes, not once a list.

Defined cases: vectors that are null, zero or hold null or non-finite components take
no part, nor do those of another length than most have; ties go to the smaller vec_id;
repeated rows are candidates of each other; fewer candidates than asked for are all
returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import shuffle_partitions, stage

K = 20
#: Vectors that centroids and the number of probes are fitted on: so many a list, within these bounds, those with the smallest hash of the id.
SAMPLE_PER_LIST, LEAST_SAMPLE, MOST_SAMPLE = 8, 20_000, 200_000
#: Queries that the number of probes is fitted on, at most.
SAMPLE_QUERIES = 100
#: Tables of no more rows are one list.
LIST_ROWS = 4096
#: Rows of a unit, about.
BLOCK_ROWS = 8192
#: Columns added up between two tests.
COLUMNS = 16
#: Times k that are measured whole to set a scan's bound.
MEASURED = 8
#: Share of living pairs above which a block is added to all pairs.
DENSE = 0.1
#: Queries that are scanned together.
BATCH = 64
#: Width of the hypothesis test: larger abandons later and errs less.
EPSILON = 2.1
RECALL = 0.95
SEED = 5


#: Norms of one band differ by this factor at most, so sums of a few bytes tell its vectors apart.
BAND = 16.0


def log_norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their largest component, and the logarithm of their norms; no square leaves the range of numbers."""
    most = np.abs(x).max(1)
    unit = x / most[:, None]
    return unit, np.log(most) + 0.5 * np.log((unit * unit).sum(1))


@dataclass
class Space:
    """What tasks need: rotation, cells, centroids by cell, probes and the largest norm (bounded by the sample and the dimension).

    Vectors are sorted into bands by norm, each divided by the largest norm of its band; a
    list holds the vectors of one band that are nearest to one centroid.
    """

    rotation: np.ndarray
    #: Logarithm of the largest norm.
    largest: float
    cells: np.ndarray
    centroids: np.ndarray
    #: First list of each cell, and the number of lists last.
    firsts: np.ndarray
    probes: int = 1

    def vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated vectors with the component that brings them to their band's norm, and the bands."""
        unit, norm = log_norms(x)
        band = np.maximum(0, np.floor((self.largest - norm) / np.log(BAND) - 1e-9)).astype(np.int64)
        scale = norm - (self.largest - band * np.log(BAND))
        x = unit * (np.exp(np.minimum(scale, 0.0)) / np.sqrt((unit * unit).sum(1)))[:, None]
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return (np.column_stack([x, rest]) @ self.rotation).astype(np.float32), band

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Rotated queries of norm 1; scaling changes no order."""
        unit, _ = log_norms(q)
        q = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        return (np.column_stack([q, np.zeros(len(q))]) @ self.rotation).astype(np.float32)

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        """The centroid of each rotated vector: the nearest of its nearest cell."""
        out = np.empty(len(x), np.int64)
        cell = nearest(x, self.cells)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            out[at] = self.firsts[c] + nearest(x[at], self.centroids[self.firsts[c] : self.firsts[c + 1]])
        return out

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: its centroid within its band."""
        turned, band = self.vectors(x)
        return band * len(self.centroids) + self.nearest_lists(turned)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 2048], centroids).argmin(1) for a in range(0, len(x), 2048)])


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        at = nearest(x, centroids)
        n = np.bincount(at, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, at, x)
        full = n > 0
        centroids[full] = (sums[full] / n[full, None]).astype(np.float32)
    return centroids


def list_count(n_rows: int) -> int:
    """Lists of a table: the root of its rows, as far as the sample can fit them."""
    return 1 if n_rows <= LIST_ROWS else min(int(np.sqrt(n_rows)), MOST_SAMPLE // SAMPLE_PER_LIST)


def sample_size(n_rows: int) -> int:
    return int(np.clip(SAMPLE_PER_LIST * list_count(n_rows), LEAST_SAMPLE, MOST_SAMPLE))


def fit(sample: np.ndarray, n_rows: int, largest: float) -> Space:
    """Space fitted on sampled vectors; ``n_rows`` and the logarithm of the ``largest`` norm are those of the whole table."""
    turn, none = rotation(sample.shape[1] + 1), np.empty((0, 0), np.float32)
    space = Space(turn, largest, none, none, np.zeros(1, np.int64))
    x, _ = space.vectors(sample)
    k = min(list_count(n_rows), max(1, len(sample) // SAMPLE_PER_LIST))
    space.cells = kmeans(x, max(1, round(k**0.5)))
    cell = nearest(x, space.cells)
    fitted = []
    for c in range(len(space.cells)):
        own = x[cell == c]
        fitted.append(kmeans(own, max(1, min(len(own), round(k * len(own) / len(x)))), 4) if len(own) else space.cells[c : c + 1])
    space.centroids, space.firsts = np.concatenate(fitted), np.cumsum([0, *map(len, fitted)])
    some = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    with np.errstate(over="ignore", invalid="ignore"):
        best = np.argsort(-np.nan_to_num(some @ sample.T), axis=1)[:, 1 : K + 1]
    order = np.argsort(distances(space.queries(some), space.centroids), axis=1)
    place = np.argsort(order, axis=1)
    depth = np.take_along_axis(place, space.nearest_lists(x)[best], axis=1)
    space.probes = 1 + int(np.quantile(depth, RECALL, method="higher")) if depth.size else len(space.centroids)
    return space


def scan(columns: list[np.ndarray], queries: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of a unit that may be among a query's k nearest of the rows allowed for it. ``columns`` are arrays [COLUMNS, rows]."""
    near = np.flatnonzero(allowed.any(0))
    columns, allowed = [c[:, near] for c in columns] if len(near) < allowed.shape[1] else columns, allowed[:, near]
    rows, width = len(near), queries.shape[1]
    parts = np.split(queries, range(COLUMNS, width, COLUMNS), axis=1)
    partial = (parts[0] ** 2).sum(1)[:, None] + (columns[0] ** 2).sum(0)[None, :] - 2 * parts[0] @ columns[0]
    partial[~allowed] = np.inf
    if rows > k:
        # The nearest by the first columns are measured whole; the k-th of them bounds what can be among the k best.
        first = min(rows, MEASURED * k)
        some = np.argpartition(partial, first - 1, axis=1)[:, :first]
        whole = sum(((block[:, some] - part.T[:, :, None]) ** 2).sum(0) for block, part in zip(columns, parts))
        whole[~np.take_along_axis(allowed, some, axis=1)] = np.inf
        bound = np.partition(whole, k - 1, axis=1)[:, k - 1] * np.float32(1 + 1e-4) + np.float32(1e-6)
    else:
        bound = np.full(len(queries), np.inf, np.float32)
    test = lambda seen: bound * np.float32(seen / width * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < width else 1)
    seen, rest = len(columns[0]), list(zip(columns[1:], parts[1:]))
    live = allowed & (partial <= test(seen)[:, None])
    # While many pairs live, a block of columns is added to all of them by one product, rows without any left out.
    own = np.flatnonzero(live.any(0))
    partial, live = partial[:, own], live[:, own]
    while rest and live.size and live.mean() > DENSE:
        block, part = rest.pop(0)
        block = block[:, own]
        partial = partial + (part**2).sum(1)[:, None] + (block**2).sum(0)[None, :] - 2 * part @ block
        seen += len(block)
        live &= partial <= test(seen)[:, None]
        some = live.any(0)
        if some.mean() < 0.7:
            own, partial, live = own[some], partial[:, some], live[:, some]
    who, at = np.nonzero(live)
    sums, at = partial[who, at], own[at]
    for block, part in rest:
        sums = sums + ((block[:, at] - part.T[:, who]) ** 2).sum(0)
        seen += len(block)
        keep = sums <= test(seen)[who]
        who, at, sums = who[keep], at[keep], sums[keep]
    return who, near[at]


def assign(space: Space):
    """Function for ``mapInArrow``: (row, vec_id, embedding) to those with the list and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                lists = pa.array(space.lists(x.astype(np.float64)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, _binary(x)], ["row", "vec_id", "list", "vector"])

    return run


def units_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each list, for sizes [band, centroid].

    Lists side by side share a unit of about ``BLOCK_ROWS`` rows, longer ones have several;
    no unit holds two bands, as a bound holds within one.
    """
    first, count = np.zeros(sizes.size, np.int32), np.ones(sizes.size, np.int32)
    unit, held = 0, 0
    for k, n in enumerate(sizes.ravel().tolist()):
        count[k] = max(1, -(-n // BLOCK_ROWS))
        if held and (held + n > BLOCK_ROWS or k % sizes.shape[1] == 0):
            unit, held = unit + 1, 0
        first[k] = unit
        held += n
        if count[k] > 1:
            unit, held = unit + int(count[k]), 0
    return first, count


def probe(space: Space, sizes: np.ndarray, k: int):
    """Function for ``mapInArrow``: queries (row, vec_id, embedding) to a row for each unit they probe, with the lists in it: in each band the nearest ``probes``, and on until 4k rows lie in them."""
    first, count = units_of(sizes)
    bands = np.flatnonzero(sizes.sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                x = _matrix(part.column(2))
                order = np.argsort(distances(space.queries(x.astype(np.float64)), space.centroids), axis=1)
                enough = [(np.cumsum(sizes[b][order], axis=1) >= min(4 * k, sizes[b].sum())).argmax(1) + 1 for b in bands]
                who, units, lists = [], [], []
                for q in range(len(x)):
                    chosen = [b * sizes.shape[1] + order[q, : max(space.probes, int(n[q]))] for b, n in zip(bands, enough)]
                    chosen = np.concatenate(chosen)
                    chosen = chosen[sizes.ravel()[chosen] > 0]
                    # A list of several units is named once for each.
                    times = count[chosen]
                    probed = np.repeat(chosen, times)
                    unit = first[probed] + np.arange(len(probed)) - np.repeat(np.cumsum(times) - times, times)
                    by = np.argsort(unit, kind="stable")
                    ends = np.flatnonzero(np.append(unit[by][1:] != unit[by][:-1], True)) + 1
                    who += [q] * len(ends)
                    units += unit[by][ends - 1].tolist()
                    lists += [x.tolist() for x in np.split(probed[by], ends[:-1])]
                take = pa.array(who, pa.int64())
                columns = [part.column(0).take(take), part.column(1).take(take), pa.array(units, pa.int32()), pa.array(lists, pa.list_(pa.int32())), _binary(x).take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "unit", "lists", "vector"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors in the precision of the table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def search_units(space: Space, dtype: str, k: int):
    """Function for ``mapInArrow``: rows sorted by (unit, is query) to the best of each query in each unit."""
    width = len(space.rotation) - 1

    def matrix(vectors: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(vectors), dtype).reshape(-1, width).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, held, asked = None, [], None, []

        def hold() -> tuple:
            vectors = matrix([r[3] for r in rows])
            turned = space.vectors(vectors)[0].T
            columns = [np.ascontiguousarray(turned[a : a + COLUMNS]) for a in range(0, len(turned), COLUMNS)]
            return columns, vectors, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2][0] for r in rows])

        def best() -> pa.RecordBatch:
            columns, vectors, row_of, id_of, list_of = held
            query_row = np.array([q[0] for q in asked])
            exact = matrix([q[3] for q in asked])
            allowed = np.stack([np.isin(list_of, q[2]) for q in asked])
            who, near = scan(columns, space.queries(exact), allowed, k + 1)
            other = row_of[near] != query_row[who]
            who, near = who[other], near[other]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (vectors[near] * exact[who]).sum(1)
            order = np.lexsort((id_of[near], -score, who))
            place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            order = order[place < k]
            who, near = who[order], near[order]
            ids = pa.array([q[1] for q in asked], pa.int64()).take(pa.array(who))
            return pa.RecordBatch.from_arrays([pa.array(query_row[who]), ids, pa.array(id_of[near]), pa.array(score[order])], ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for at, is_query, row, vec_id, lists, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if at != unit:
                    if asked and held:
                        yield best()
                    unit, rows, held, asked = at, [], None, []
                if not is_query:
                    rows.append((row, vec_id, lists, vector))
                    continue
                if held is None and rows:
                    held, rows = hold(), []
                asked.append((row, vec_id, lists, vector))
                if len(asked) == BATCH:
                    if held:
                        yield best()
                    asked = []
        if asked and held:
            yield best()

    return run


def sound(embedding: str) -> F.Column:
    """Whether a vector takes part."""
    limit = F.lit(float("inf"))
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def search(vectors: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query among all other rows."""
    spark = vectors.sparkSession
    # Vectors travel in the table's precision; sums are taken in double precision.
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    vector, dtype = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    good = vectors.filter(sound("embedding")).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast(vector).alias("embedding"))
    # The logarithm of the norm, by way of the largest component, as squares may leave the range of numbers.
    most = F.array_max(F.transform(F.col("embedding").cast("array<double>"), F.abs))
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    widths = good.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.max(F.log(most) + F.log(square) / 2).alias("norm"))
    most = widths.orderBy(F.desc("n"), "width").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = stage(good.filter(F.size("embedding") == most.width), "vectors")
    sample = good.select(F.xxhash64("vec_id", "row").alias("h"), "embedding").orderBy("h").limit(sample_size(most.n))
    space = fit(np.array([r.embedding for r in sample.select("embedding").collect()], np.float64), most.n, float(most.norm))

    placed = stage(good.mapInArrow(assign(space), "row long, vec_id long, list int, vector binary"), "lists")
    counts = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # Bands by centroids; a list's number says which. Norms of numbers lie in 512 bands at most.
    sizes = np.zeros((max(counts) // len(space.centroids) + 1, len(space.centroids)), np.int64)
    sizes.ravel()[list(counts)] = list(counts.values())
    first, count = units_of(sizes)
    # One row a list that holds rows: at most MOST_SAMPLE / SAMPLE_PER_LIST of them a band.
    units = F.broadcast(spark.createDataFrame([(k, int(first[k]), int(count[k])) for k in sorted(counts)], "list int, first int, n int"))
    data = placed.join(units, "list").select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))).cast("int").alias("unit"), F.lit(False).alias("is_query"), "row", "vec_id", F.array("list").alias("lists"), "vector")
    asked = good.filter(is_query).mapInArrow(probe(space, sizes, k), "row long, vec_id long, unit int, lists array<int>, vector binary")
    asked = asked.select("unit", F.lit(True).alias("is_query"), "row", "vec_id", "lists", "vector")
    dealt = data.unionByName(asked).repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "is_query")
    found = dealt.mapInArrow(search_units(space, dtype, k), "row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")

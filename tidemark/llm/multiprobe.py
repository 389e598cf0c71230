"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``hashes`` Gaussian projections, each cut into slots of one width; the slots are its bucket.
A query visits, in every table, its own bucket and the ``probes`` - 1 perturbed ones (each slot kept, one down or one
up) with the best estimated success: least sum of squared distances to the slot borders that are crossed. Candidates of
all tables are reranked by exact Euclidean distance in double precision.

The width is ``width`` times the spread of the projections, and ``probes`` the first of ``probe_steps`` that reaches
``aim`` of the true neighbours on a sample (``sample_vectors`` vectors, ``sample_queries`` of them as queries; a hash of
vec_id chooses). That is all that is fitted; every vector is indexed.

Equal vectors are indexed once, under their k + 1 smallest ids: no other copy can be among anyone's k nearest. A
bucket splits into chunks of at most about ``chunk`` vectors by a hash; its queries visit all chunks. Each task keeps
the k nearest of a query for each chunk, so no join lists all candidates.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part. Ties in distance go to the smaller vec_id. A query with fewer than k candidates found gets the rest from
an exact scan over all vectors (all of them, if the table has fewer). Rows that repeat a vec_id with one vector are
one; with several vectors each is a candidate of its own and the nearest counts. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, read, ship_package, shuffle_width


@dataclass(frozen=True)
class Shape:
    tables: int = 8
    hashes: int = 6
    width: float = 1.5
    aim: float = 0.97
    probe_steps: tuple[int, ...] = (16, 32, 64, 128, 256, 729)
    sample_vectors: int = 4000
    sample_queries: int = 200
    chunk: int = 4096
    seed: int = 11


class Hashing:
    """The projections of all tables. A pure function of its arguments, so every task has the same one."""

    def __init__(self, dim: int, spread: float, shape: Shape):
        rng = np.random.default_rng(shape.seed)
        self.shape = shape
        self.axes = rng.normal(size=(dim, shape.tables * shape.hashes)) / (shape.width * spread)
        self.shift = rng.uniform(size=shape.tables * shape.hashes)
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=shape.hashes)), np.int64)
        mixer = rng.integers(1, 2**63, shape.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixer = mixer.view(np.int64)

    def slots(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and place within it, by vector, table, hash."""
        at = (vectors @ self.axes + self.shift).reshape(len(vectors), self.shape.tables, self.shape.hashes)
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    def bucket(self, slot: np.ndarray) -> np.ndarray:
        return (slot * self.mixer).sum(axis=-1)

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each vector visits as a query, by vector, table, order of estimated success."""
        slot, place = self.slots(vectors)
        cost = np.zeros((*slot.shape[:2], len(self.moves)))
        for m in range(self.shape.hashes):
            step = self.moves[:, m]
            cost += np.where(step == 0, 0.0, np.where(step < 0, place[:, :, m, None], 1 - place[:, :, m, None])) ** 2
        probes = min(probes, len(self.moves))
        best = np.argsort(cost, axis=-1, kind="stable")[:, :, :probes]
        return self.bucket(slot[:, :, None, :] + self.moves[best])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of doubles of the most frequent length."""
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = "v is not null and vec_id is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)"
    own = own.where(F.expr(good))
    common = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return own.where(F.size("v") == (common["d"] if common else 0))


def _binary(frame: DataFrame, dim: int, others: list[str]) -> DataFrame:
    """Column v as the bytes of its doubles, for cheap transport."""
    schema = frame.select(*others).schema.add("v", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(others)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
            raw, step = flat.tobytes(), dim * 8
            packed = pa.array([raw[i * step : (i + 1) * step] for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), packed], names=[*others, "v"])

    return frame.select(*others, "v").mapInArrow(run, schema)


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least distances of each row, ties by id."""
    columns = distance.shape[1]
    if columns <= k:
        return tuple(x.ravel() for x in np.indices(distance.shape))
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(distance <= bound)
    order = np.lexsort((ids[column], distance[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(distance)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], column[keep]


def _norms(gap: np.ndarray) -> np.ndarray:
    return np.sqrt((gap * gap).sum(axis=1))


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, by differences, so that equal vectors are at exactly 0."""
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries):
        out[i] = _norms(vectors - q)
    return out


def fit(vectors: DataFrame, dim: int, k: int, shape: Shape) -> tuple[float, int]:
    """(spread of the projections, probes) from a bounded sample that goes to the driver."""
    count = vectors.count()
    share = min(1.0, shape.sample_vectors / max(1, count))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).collect()
    rows.sort(key=lambda r: r["vec_id"])
    sample = np.array([np.frombuffer(r["v"], np.float64) for r in rows]).reshape(-1, dim)
    if len(sample) < 2:
        return 1.0, shape.probe_steps[0]
    spread = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    hashing = Hashing(dim, spread, shape)
    queries = sample[:: max(1, len(sample) // shape.sample_queries)]
    far = distances(queries, sample)
    truth = np.argsort(far, axis=1)[:, 1 : k + 1]
    own = hashing.bucket(hashing.slots(sample)[0])
    for probes in shape.probe_steps:
        visited = hashing.probed(queries, probes)
        hit = [np.isin(own[truth[i], t], visited[i, t]) for i in range(len(queries)) for t in range(shape.tables)]
        found = np.array(hit).reshape(len(queries), shape.tables, -1).any(axis=1).mean()
        if found >= shape.aim:
            return spread, probes
    return spread, shape.probe_steps[-1]


def _search(blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, ids, score) from rows (slot..., kind 0 vector / 1 query, id, ids, v) dealt and sorted by slot, kind.

    A task holds one chunk's vectors at a time; queries stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, firsts = None, [], [], None
        matrix = np.empty((0, dim))

        def solve(part: pa.RecordBatch) -> pa.RecordBatch:
            queries = _matrix(part.column(5), dim)
            row, column = _nearest(distances(queries, matrix), firsts, k + 1)
            score = _norms(matrix[column] - queries[row])
            return pa.RecordBatch.from_arrays([part.column(3).take(pa.array(row)), ids_array.take(pa.array(column)), pa.array(score)], names=["query", "ids", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                key = tuple(keys[lo])
                if key[:2] != now:
                    now, vectors, ids = key[:2], [], []
                if key[2] == 0:
                    vectors.append(_matrix(part.column(5), dim))
                    ids.append(part.column(4))
                elif vectors:
                    if len(vectors) > 1 or len(matrix) != len(vectors[0]) or matrix is not vectors[0]:
                        matrix = np.concatenate(vectors)
                        ids_array = pa.chunked_array(ids).combine_chunks()
                        firsts = pc.list_element(ids_array, 0).to_numpy(zero_copy_only=False)
                        vectors, ids = [matrix], [ids_array]
                    for at in range(0, part.num_rows, 256):
                        yield solve(part.slice(at, 256))

    return blocks.mapInArrow(run, "query long, ids array<long>, score double")


def search(vectors: DataFrame, queries: F.Column, k: int = 10, shape: Shape = Shape()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that ``queries`` (over vec_id) selects."""
    spark = vectors.sparkSession
    ship_package(spark)
    own = usable(vectors)
    first = own.select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = first["d"]
    own = cut(_binary(own, dim, ["vec_id"]), "multiprobe-vectors")
    copies = own.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(shuffle_width(spark))))
    for by in (["v", "salt"], ["v"]):  # thousands of copies are cut down side by side before they meet
        copies = copies.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k + 1)
    copies = copies.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = cut(copies.select(F.element_at("ids", 1).alias("vec_id"), "ids", "v"), "multiprobe-distinct")
    asked = own.where(queries).select("vec_id", "v").distinct()
    spread, probes = fit(distinct.select("vec_id", "v"), dim, k, shape)

    def hashed(frame: DataFrame, kind: int, others: list[str], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashing = Hashing(dim, spread, shape)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    matrix = _matrix(part.column(len(others)), dim)
                    visited = hashing.probed(matrix, probes) if kind else hashing.bucket(hashing.slots(matrix)[0])[:, :, None]
                    n, tables, each = visited.shape
                    row = np.repeat(np.arange(n), tables * each)
                    table = np.tile(np.repeat(np.arange(tables), each), n)
                    bucket = visited.ravel() ^ (table * 0x5851F42D4C957F2D)
                    columns = [part.column(i).take(pa.array(row)) for i in range(len(others) + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], names=["bucket", *others, "v"])

        return frame.select(*others, "v").mapInArrow(run, f"bucket long, {schema}, v binary")

    index = hashed(distinct, 0, ["vec_id", "ids"], "vec_id long, ids array<long>")
    sizes = cut(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "multiprobe-buckets")
    chunks = F.ceil(F.col("n") / shape.chunk).cast("int")
    left = index.join(sizes, "bucket").select(
        "bucket", F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "ids", "v"
    )
    right = hashed(asked, 1, ["vec_id"], "vec_id long").join(sizes, "bucket")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), chunks - 1)))
    right = right.select("bucket", F.col("part").cast("int").alias("part"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.lit(None).cast("array<long>").alias("ids"), "v")
    blocks = left.unionByName(right).repartition(shuffle_width(spark), "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    found = _search(blocks, dim, k)
    return _ranked(found, asked, distinct, dim, k)


def _ranked(found: DataFrame, asked: DataFrame, distinct: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest of what the tables found; queries left short are completed by an exact scan in blocks."""
    found = cut(_best(found, k), "multiprobe-found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = cut(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "multiprobe-short")
    if short.isEmpty():
        return found
    width = shuffle_width(found.sparkSession)
    vectors = distinct.select(F.lit(0).cast("long").alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(width)).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "ids", "v")
    each = short.select(F.lit(0).cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("part"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.lit(None).cast("array<long>").alias("ids"), "v")
    scanned = _best(_search(vectors.unionByName(each).repartition(width, "bucket", "part").sortWithinPartitions("bucket", "part", "kind"), dim, k), k)
    rest = found.join(full, "query_id", "left_semi")
    return rest.unionByName(scanned)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest ids. Chunks of one table may repeat what another found; a score is exact, so repeats agree."""
    spread = found.select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    spread = spread.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_multiprobe(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

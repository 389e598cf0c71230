"""SimHash near-duplicates by pigeonhole blocks.

Words of the text with A-Z lower-cased form shingles; each shingle's XXH64 (seed 42) votes on 64 bits; a bit is set
when over half of the votes are. Fingerprints link when they differ in ``distance`` bits or fewer.

Blocks: the 64 bits fall into distance + 3 blocks. Two linked fingerprints agree in at least three of them, so a
fingerprint enters one bucket for each choice of three blocks, and linked ones meet. A bucket of over ``bucket``
fingerprints splits by the same argument: its free bits fall into distance + 1 parts, of which two linked ones agree
in one at least. After two splits a bucket can hold but a few thousand distinct fingerprints, whatever the data. In a
bucket all distances are verified, and what links leaves as a star, one edge a fingerprint, never as all pairs.
Equal fingerprints are one node throughout, so thousands of exact copies cost what one costs.

Defined results: fewer words than a shingle make one shingle of them all; no word at all (null, empty, blank) makes
fingerprint zero, linked like any other. Repeated rows give repeated rows; a component's id is the smallest doc_id in
it (null only if all are null); texts of any length are taken whole; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, cut, map_texts, read, released, ship_package, shuffle_width
from .components import components
from .line_dedup import Lines, Rule, removed_lines

_VOTES = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size).tolist()
    stop = stop.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, stop[k - 1 :])), np.uint64, len(words) - k + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _VOTES):
        votes += _count_bits(hashes[at : at + _VOTES])
    return int((2 * votes > len(hashes)) @ (1 << np.arange(64, dtype=np.uint64)))


def _count_bits(hashes: np.ndarray) -> np.ndarray:
    rows = -(-len(hashes) // 255) * 255
    padded = np.zeros(rows, "<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 fit a byte


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp, the fingerprint as a signed long."""

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

        return run

    return map_texts(docs, keep, make, "fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of n near-equal runs of the given bits."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def masks(distance: int) -> list[int]:
    """What a first bucket holds fixed: any three of distance + 3 blocks."""
    return [a | b | c for a, b, c in combinations(_parts(list(range(64)), distance + 3), 3)]


def finer(mask: int, distance: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in _parts(free, distance + 1)]


def _keyed(rows: DataFrame, mask: F.Column) -> DataFrame:
    return rows.select("fp", F.explode(mask).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def bucketed(fps: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(mask, key, fp) of every bucket with two fingerprints or more; linked ones share a bucket of bounded size."""
    level = masks(distance)
    rows = _keyed(fps, F.array(*[F.lit(_signed(m)) for m in level]))
    ready = None
    for depth in range(3):
        full = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = cut(rows.join(full, ["mask", "key"]), "simhash-buckets")
        fits = rows if depth == 2 else rows.where(F.col("n") <= bucket)
        fits = fits.select("mask", "key", "fp")
        ready = fits if ready is None else ready.unionByName(fits)
        rows = rows.where(F.col("n") > bucket)
        if depth == 2 or rows.isEmpty():
            return ready
        below = {m: finer(m, distance) for m in level}
        level = sorted({m for own in below.values() for m in own})
        table = F.create_map(*[x for m, own in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(o)) for o in own]))])
        rows = _keyed(rows, F.element_at(table, F.col("mask")))
    return ready


def _star(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint of a bucket to the least one of its component within the bucket."""
    fp = np.unique(fp)
    label = np.arange(len(fp))
    blocks = [np.nonzero(np.bitwise_count(fp[at : at + 512, None] ^ fp[None, :]) <= distance) for at in range(0, len(fp), 512)]
    near = [(a + at, b) for (a, b), at in zip(blocks, range(0, len(fp), 512))]
    while True:
        then = label.copy()
        for a, b in near:
            np.minimum.at(then, a, label[b])
        then = then[then]
        if (then == label).all():
            break
        label = then
    moved = label != np.arange(len(fp))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def links(fps: DataFrame, distance: int = 2, bucket: int = 512) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly those in one component of the link graph."""
    ship_package(fps.sparkSession)
    rows = bucketed(fps, distance, bucket)
    rows = rows.repartition(shuffle_width(rows.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            start, stop = np.append(0, edge), np.append(edge, len(rows))
            fp = rows[:, 2].view(np.uint64)
            two = start[stop - start == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            found = [(rows[two, 2], rows[two + 1, 2])]
            found += [_star(fp[a:z], distance) for a, z in zip(start.tolist(), stop.tolist()) if z - a > 2]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            rows = np.concatenate(held)
            if not len(rows):
                continue
            differs = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            done = int(differs[-1]) + 1 if len(differs) else 0  # the last bucket may go on in the next batch
            if done:
                yield from emit(np.ascontiguousarray(rows[:done]))
            held = [rows[done:]]
        if held and len(held[0]):
            yield from emit(np.ascontiguousarray(np.concatenate(held)))

    return rows.select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    made = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "simhash-fingerprints")
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance), "simhash").withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "root").select("fp", "component_id")
    return made.join(classes, "fp").select("doc_id", "fp", "component_id")


def alike(texts: DataFrame, rule: Rule, distance: int = 3) -> DataFrame:
    """(line, earlier) for every distinct text with a word (by its line id) but the first of its class: that first one.

    Classes are the components of fingerprints over the rule's shingles that differ in ``distance`` bits or fewer. The
    first of a class is the earliest by (doc_id, hash of the text); a class of n texts gives n - 1 pairs.
    """

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            lines = Lines([(t or "").encode() for t in texts], rule)
            own, line = lines.text[lines.eligible], np.zeros(len(texts), np.int64)
            line[own] = lines.ids()[0]
            fp = np.zeros(len(texts), np.uint64)
            fp[own] = [fingerprint(texts[k], rule.shingle) for k in own.tolist()]
            return {"fp": fp.view(np.int64), "line": pa.array(line, mask=~np.isin(np.arange(len(texts)), own)), "number": lines.number}

        return run

    spark = texts.sparkSession
    with released(spark, "simhash-pairs"):
        made = map_texts(texts, ("doc_id",), make, "fp long, line long, number long").where("line is not null")
        nodes = cut(made.groupBy("fp", "line").agg(F.min(F.struct("doc_id", "number")).alias("place")), "simhash-nodes")
        roots = components(links(nodes.select("fp").distinct(), distance), "simhash").withColumnRenamed("node", "fp")
        classed = nodes.join(roots, "fp", "left").select("line", "place", F.coalesce("root", "fp").alias("root"))
        first = classed.groupBy("root").agg(F.min(F.struct("place", "line")).alias("first"))
        pairs = classed.join(first, "root").select("line", F.col("first.line").alias("earlier")).where("line <> earlier")
        return cut(pairs, "simhash-pairs")


def keep_one(docs: DataFrame, shingle: int = 5, distance: int = 3) -> DataFrame:
    """The rows, all columns as they are, that no earlier one (by doc_id, null last) resembles: the sets of five-word
    shingles of every two that stay have a Jaccard similarity under 0.8, and each that goes has an earlier partner.

    Fingerprints find the classes, and each member is held against the first of its class, by exact Jaccard similarity.
    64 bits can't tell 0.8 from chance, so a text that its class doesn't settle asks the exact join of line dedup, with
    shingles for words. Texts without a word are alike. Of rows that repeat a doc_id and text the least stays, by the
    columns in order (they need an order: no maps). Rows without doc_id count as later than all others.
    """
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("__id"), "text")
    texts = rows.select(F.col("__id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = texts.where(~F.col("text").rlike(WORD)).agg(F.min("doc_id")).first()[0]
    rule = Rule(shingle=shingle, floor=2)
    gone = removed_lines(texts, rule, likely=alike(texts, rule, distance)).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            raw = [(t or "").encode() for t in texts]
            keys = np.fromiter((xxhash.xxh64_intdigest(r) if r.strip() else 0 for r in raw), np.uint64, len(raw)).view(np.int64)
            return {"__key": keys, "__blank": [not r.strip() for r in raw]}

        return run

    marked = map_texts(rows, ("__row", "__id"), make, "__key long, __blank boolean")
    marked = marked.where(~F.col("__blank") | (F.col("__id") == F.lit(empty)))
    kept = marked.join(gone, ["__id", "__key"], "left_anti")
    one = kept.groupBy("__id", "__key").agg(F.min("__row").alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

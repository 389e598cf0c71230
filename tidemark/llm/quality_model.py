"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed features: words, character 3- and 4-grams within blank-padded
words, and pairs of words one and two apart (the pair's hash is symmetric, so a repeated word falls in one bucket). A
softmax layer over two classes follows. Vectors and layer are learned together by numpy stochastic gradient descent.

Averaging and a linear layer commute, so scoring needs one number a bucket: its vector's contribution to the logit
difference. A text's score is the sigmoid of the mean over its features.

Learning rows: labelled, outside the held-out fold, at most about ``sample_per_class`` a class (a hash of doc_id
decides), and of these, in order of another hash, as many as hold ``sample_features`` features together: what reaches the
driver is bounded whatever their length. That is the only sampling; their whole texts are used.

Defined results: null and empty texts have no features and get the sigmoid of the bias. Without labels of both classes
every score is 0.5. Labels other than 0 and 1, and null ones, teach nothing; of several labels of one document the
greatest counts. One row per input row; texts are hashed whole, in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, held_out, map_texts, read

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 21


@dataclass(frozen=True)
class Shape:
    bits: int = 17
    dim: int = 8
    epochs: int = 12
    rate: float = 0.4
    seed: int = 7
    sample_per_class: int = 1500
    sample_features: int = 12_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(raw: bytes, before: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of all features of a UTF-8 text, by kind. ``before``: the hashes of the two words before it."""
    byte = np.frombuffer(b" " + raw + b" ", np.uint8)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    keep = ~(blank & np.concatenate(([False], blank[:-1])))
    byte = np.where(blank, 32, byte)[keep].astype(np.uint64)
    blank = blank[keep]
    start = np.flatnonzero(blank[:-1]) + 1
    if len(byte) < 3:
        return []
    stop = np.append(start[1:] - 1, len(byte) - 1)
    place = np.arange(len(byte)) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(byte))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _ODD, np.uint64))
        words = np.add.reduceat(np.where(blank, np.uint64(0), byte * power[place]), start)
        words = _mix(words + (stop - start).astype(np.uint64) * _ODD)
        out = [words]
        for n in (3, 4):
            rolled = np.zeros(max(0, len(byte) - n + 1), np.uint64)
            crossing = np.zeros(len(rolled), bool)
            for i in range(n):
                rolled = rolled * np.uint64(0x100000001B3) + byte[i : i + len(rolled)]
                if 0 < i < n - 1:
                    crossing |= blank[i : i + len(rolled)]
            out.append(_mix(rolled[~crossing] * _ODD + np.uint64(n)))
        line = np.concatenate((before, words))
        for gap in (1, 2):
            pairs = line[:-gap] ^ line[gap:]
            out.append(_mix(pairs[max(0, len(before) - gap) :] + np.uint64(gap)))
    return out


def buckets(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's features and their weights, which add up to 1. Each kind has an equal share."""
    kinds: list[list[np.ndarray]] = [[] for _ in range(5)]
    for found in features(text):
        for kind, own in zip(kinds, found):
            kind.append(own)
    ids, weights = [], []
    for kind in kinds:
        found = np.concatenate(kind) if kind else np.empty(0, np.uint64)
        if len(found):
            ids.append((found >> np.uint64(64 - bits)).astype(np.int64))
            weights.append(np.full(len(found), 1 / len(found)))
    if not ids:
        return np.empty(0, np.int64), np.empty(0)
    own, place = np.unique(np.concatenate(ids), return_inverse=True)
    weight = np.bincount(place, weights=np.concatenate(weights))
    return own, weight / len(ids)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def features(text: str | None) -> Iterator[list[np.ndarray]]:
    """Hashes by kind of all features of a text, a piece at a time. Pieces end at a blank, and word pairs go across."""
    raw, at, before = (text or "").encode(), 0, np.empty(0, np.uint64)
    while at < len(raw):
        blank = _BLANK.search(raw, at + _PIECE)
        end = blank.start() if blank else len(raw)
        if found := _hashes(raw[at:end], before):
            yield found
            before = np.concatenate((before, found[0]))[-2:]
        at = end


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], shape: Shape) -> tuple[np.ndarray, float]:
    """Rows (label, buckets, weights) to (logit difference by bucket, bias)."""
    rng = np.random.default_rng(shape.seed)
    vectors = rng.normal(0, 0.1, (1 << shape.bits, shape.dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, shape.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(1 << shape.bits, 1e-6, np.float32)
    total = shape.epochs * len(rows)
    step = 0
    for _ in range(shape.epochs):
        for k in rng.permutation(len(rows)).tolist():
            label, own, weight = rows[k]
            rate = shape.rate * (1 - step / total)
            step += 1
            mean = weight @ vectors[own] if len(own) else np.zeros(shape.dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            down = layer.T @ p
            layer -= 0.1 * rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            if len(own):  # steps shrink with a bucket's own history (Adagrad), as weights differ by orders of magnitude
                seen[own] += weight**2 * float(down @ down)
                vectors[own] -= (rate * weight / np.sqrt(seen[own]))[:, None] * down[None, :]
    return (vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> tuple[np.ndarray, float]:
    """``docs``: doc_id, text; ``labels``: doc_id, quality; learning rows only.

    The sample is drawn from the labels, so only its ids, at most about 2 x sample_per_class, meet the texts, and they
    do so by broadcast: no text is shuffled. Only the sample's features reach the driver.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(1 << shape.bits), 0.0
    limit = F.when(F.col("quality") == 1, min(1.0, shape.sample_per_class / sizes[1])).otherwise(min(1.0, shape.sample_per_class / sizes[0]))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit * (1 << 20))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            made = [buckets(t, shape.bits) for t in texts]
            return {"own": [a.astype(np.int32).tobytes() for a, _ in made], "weight": [w.astype(np.float32).tobytes() for _, w in made]}

        return run

    made = cut(map_texts(chosen, ("doc_id", "quality"), make, "own binary, weight binary"), "quality-features")
    sizes = made.select("doc_id", F.expr("length(own) DIV 4").alias("n")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()
    taken, total = [], 0
    for row in sizes:
        total += row["n"]
        if total <= shape.sample_features:
            taken.append(row["doc_id"])
    found = made.where(F.col("doc_id").isin(taken)).collect() if len(taken) < len(sizes) else made.collect()
    found.sort(key=lambda r: (r["doc_id"], r["own"], r["weight"]))
    return train([(r["quality"], np.frombuffer(r["own"], np.int32), np.frombuffer(r["weight"], np.float32)) for r in found], shape)


def predict(docs: DataFrame, model: tuple[np.ndarray, float], shape: Shape = Shape(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score and predicted. The model is one array of 2^bits numbers, whatever the corpus."""
    sent = (model[0].astype(np.float32), model[1])

    def make() -> Callable[[list], dict]:
        logit, bias = sent

        def one(text: str | None) -> float:
            kinds: list[list[float]] = [[0.0, 0] for _ in range(5)]
            for found in features(text):
                for kind, own in zip(kinds, found):
                    kind[0] += float(logit[(own >> np.uint64(64 - shape.bits)).astype(np.int64)].sum(dtype=np.float64))
                    kind[1] += len(own)
            means = [s / n for s, n in kinds if n]
            z = bias + (sum(means) / len(means) if means else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        def run(texts: list) -> dict:
            scores = [one(t) for t in texts]
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return run

    return map_texts(docs, keep, make, "score double, predicted int")


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out())
    learning = docs.where(~F.col("held_out"))
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return predict(docs, fit(learning, labels), keep=("doc_id", "held_out"))

"""Substring dedup: words covered by a window that an earlier document holds are removed, by FM-indexes per shard.

Every document streams against the shards that can hold its windows, not against all. A window's anchor is the least
hash among the word k-grams in it, so equal windows have equal anchors wherever they stand. A document falls into runs
of windows with one anchor, about 20 words apart; runs whose anchor only one document has can't match and stay
behind. The rest are grouped by (anchor, words of the run), so that copies count once, and each group's first holder
sends the run's words to the shard of the anchor. A shard's task builds one FM-index of its runs in order of doc_id
and finds, by backward search, each run's windows that an earlier document holds. A later member of a group has every
window of the run in the first holder, which the same index contains.

Defined results: null text counts as no words; under ``window`` words nothing is removed. A row without doc_id has no
order and keeps all its words. Rows that repeat a doc_id are one document to the rule. Words are compared by 64-bit
hashes, and runs by 128 bits of those (anchor and content) before one counts as a copy of another. Texts of any length are taken whole; empty tables give empty ones; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, hold, map_texts, read, ship_package, shuffle_width, slices
from .fm_index import matched_windows
from .line_dedup import powers

_P = np.uint64(0x9E3779B97F4A7C15)
_CODE_BYTES = 8


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def _codes(words: list[bytes], known: _Codes) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(codes: np.ndarray, window: int, gram: int, longest: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of the run's words, first window, windows) of every run of windows with one anchor."""
    n = len(codes)
    hashes = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        hashes = hashes * _P + codes[j : j + len(hashes)]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    width, span, least = window - gram + 1, 1, hashes
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(start, len(least)))
    pieces = -(-size // longest)  # pieces of a run keep its anchor and so its shard
    offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole = np.repeat(size, pieces)
    start = np.repeat(start, pieces) + offset * longest
    size = np.minimum(whole - offset * longest, longest)
    power, inverse = powers(n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[:n])))
    content = (sums[start + size + window - 1] - sums[start]) * inverse[start]  # the same wherever the words stand
    return least[start], content, start, size


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, key, anchor, content, start, windows) of all runs; key tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            for part in slices(batch, 1):
                made = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = (text or "").encode()
                    words = raw.split()
                    if len(words) >= window:
                        found = runs(_codes(words, known), window, gram)
                        size = len(found[0])
                        made.append((np.full(size, doc), np.full(size, xxhash.xxh64_intdigest(raw), np.uint64), *found))
                if made:
                    doc, key, anchor, content, start, windows = map(np.concatenate, zip(*made))
                    columns = [doc, key.view(np.int64), anchor.view(np.int64), content.view(np.int64), start.astype(np.int32), windows.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "key", "anchor", "content", "start", "windows"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, key long, anchor long, content long, start int, windows int")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): texts compressed for the way to another task."""

    def make() -> Callable[[list], dict]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def run(texts: list) -> dict:
            raw = [(t or "").encode() for t in texts]
            keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)).view(np.int64)
            return {"key": keys, "packed": [squeeze.compress(r) for r in raw]}

        return run

    return map_texts(docs, ("doc_id",), make, "key long, packed binary")


def _unpack(packed: bytes, squeeze: zstandard.ZstdDecompressor) -> list[bytes]:
    return squeeze.decompress(packed).split()


def _send(docs: DataFrame, groups: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, anchor, content, doc_id, codes): the words of each group's run, from the text of its first holder."""
    wanted = groups.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "content", "start", "windows")).alias("runs"))
    wanted = wanted.select("doc_id", "key", "runs.anchor", "runs.content", "runs.start", "runs.windows")
    frame = _packed(docs).join(wanted, ["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squeeze = _Codes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 1):
                out: list[list] = [[], [], [], []]
                for doc, packed, anchor, content, start, windows in zip(*(c.to_pylist() for c in part.columns)):
                    codes = _codes(_unpack(packed, squeeze), known)
                    out[0] += anchor
                    out[1] += content
                    out[2] += [doc] * len(anchor)
                    out[3] += [codes[s : s + n + window - 1].tobytes() for s, n in zip(start, windows)]
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                        names=["anchor", "content", "doc_id", "codes"],
                    )

    sent = frame.select("doc_id", "packed", "anchor", "content", "start", "windows").mapInArrow(run, "anchor long, content long, doc_id long, codes binary")
    return sent.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))


def _search(sent: DataFrame, window: int, shards: int) -> DataFrame:
    """(anchor, content, owner, first, last): ranges of the run's windows that an earlier document than its owner holds."""
    sent = sent.select("shard", "anchor", "content", "doc_id", "codes").repartition(shuffle_width(sent.sparkSession), "shard").sortWithinPartitions("shard", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            _, anchor, content, doc, codes = zip(*rows)
            size = np.fromiter((len(c) // _CODE_BYTES for c in codes), np.int64, len(codes))
            owner = np.unique(np.array(doc, np.int64), return_inverse=True)[1]
            ranges = matched_windows(np.frombuffer(b"".join(codes), np.uint64), size, owner, window)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(doc, pa.int64())]
                + [pa.array([[int(r[k]) for r in own] for own in ranges], pa.list_(pa.int32())) for k in (0, 1)],
                names=["anchor", "content", "owner", "first", "last"],
            )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return sent.mapInArrow(run, "anchor long, content long, owner long, first array<int>, last array<int>")


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 10, shards_per_task: int = 1) -> DataFrame:
    """(doc_id, key, start array<int>, stop array<int>): word spans to remove, for rows that have any."""
    spark = docs.sparkSession
    ship_package(spark)
    shards = shards_per_task * shuffle_width(spark)
    found = hold(_anchored(docs, window, gram))
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    found = hold(found.join(shared, "anchor", "left_semi"))
    holder = F.min(F.struct("doc_id", "key", "start", "windows")).alias("h")
    groups = found.groupBy("anchor", "content").agg(holder).select("anchor", "content", "h.*")
    ranges = cut(_search(_send(docs, groups, window, shards), window, shards), "substring-ranges")
    own = found.join(ranges, ["anchor", "content"])
    own = own.select(
        "doc_id",
        "key",
        F.when(F.col("doc_id") > F.col("owner"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("z"))))
        .otherwise(F.zip_with("first", "last", lambda a, z: F.struct((F.col("start") + a).alias("a"), (F.col("start") + z).alias("z"))))
        .alias("spans"),
    ).where(F.size("spans") > 0)
    spans = own.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return spans.select("doc_id", "key", F.col("spans.a").alias("start"), F.transform("spans.z", lambda z: z + (window - 1)).alias("stop"))


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 10, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``), or their SHA-256 (``kept_sha256``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, window, gram)
    frame = _packed(docs).join(spans, ["doc_id", "key"], "left").select("doc_id", "packed", "start", "stop")
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 1):
                sizes, gone, kept = [], [], []
                for packed, start, stop in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    words = _unpack(packed, squeeze)
                    sizes.append(len(words))
                    if start:
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, stop, -1)
                        stay = np.cumsum(step[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist()) if s]
                    gone.append(sizes[-1] - len(words))
                    text = b" ".join(words)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", last],
                )

    return frame.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True)

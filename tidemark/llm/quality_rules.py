"""Quality rules: word and line statistics of whole texts, and zstandard compression bands.

A text that passes the base rules is kept if its compression ratio (compressed bytes / bytes) lies within the band for
its length and if no more than ``odd_chunks`` of its fixed chunks lie outside the chunk band. Short texts compress
less, so the bands depend on length: below the floor a text repeats itself, above the ceiling it is noise (keys,
encoded binary) rather than prose.

Defined results: a null or empty text has all counts 0, base_failed true, kept false. One row per input row, repeated
rows included; a text of any length is handled whole, one text at a time; an empty table gives an empty one; other
columns of the input don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blanks, filter_texts, has_word, map_texts, read

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "base_failed boolean, kept boolean, ratio double, odd_chunk_share double"


@dataclass(frozen=True)
class Bands:
    """Limits on compression ratios. ``whole`` rows: (texts below this many UTF-8 bytes, floor, ceiling)."""

    whole: tuple[tuple[float, float, float], ...] = field(
        default=(
            (512, 0.40, 0.90),
            (1024, 0.38, 0.80),
            (2048, 0.34, 0.72),
            (4096, 0.31, 0.66),
            (16384, 0.27, 0.62),
            (65536, 0.22, 0.58),
            (float("inf"), 0.15, 0.56),
        )
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.25, 0.66)
    odd_chunks: float = 0.25
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def judge(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [line for line in text.split("\n") if has_word(line)]
    repeated = repeat_words(words)
    failed = n < bands.min_words or 100 * repeated > bands.repeat_percent * n
    ratio = len(compressor.compress(raw)) / len(raw) if raw else 0.0
    odd = _odd_share(raw, ratio, bands, compressor)
    low, high = next((lo, hi) for below, lo, hi in bands.whole if len(raw) < below)
    kept = not failed and low <= ratio <= high and odd <= bands.odd_chunks
    return n, len(text) - blanks(text), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated, failed, kept, ratio, odd


def _odd_share(raw: bytes, ratio: float, bands: Bands, compressor: zstandard.ZstdCompressor) -> float:
    """Share of the fixed chunks outside the chunk band. For a rest of under half a chunk the last one ends at the text's end."""
    size = bands.chunk_bytes
    if len(raw) < size:
        return 0.0
    chunks = [raw[i : i + size] if len(raw) - i >= size // 2 else raw[-size:] for i in range(0, len(raw), size)]
    low, high = bands.chunk
    return sum(not low <= len(compressor.compress(c)) / len(c) <= high for c in chunks) / len(chunks)


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), bands: Bands | None = None) -> DataFrame:
    """Columns ``keep``, the base statistics, base_failed, kept, and the two figures that the bands judge."""
    bands = bands or Bands()
    names = [x.split()[0] for x in f"{STATS}, {VERDICT}".split(", ")]

    def make() -> Callable[[list], dict]:
        compressor = zstandard.ZstdCompressor(level=bands.level)

        def run(texts: list) -> dict:
            return dict(zip(names, zip(*(judge(t, bands, compressor) for t in texts))))

        return run

    return map_texts(docs, keep, make, f"{STATS}, {VERDICT}")


def keep_good(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    bands = bands or Bands()

    def make() -> Callable[[list], list[bool]]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        return lambda texts: [judge(t, bands, compressor)[6] for t in texts]

    return filter_texts(docs, make)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return score(docs)

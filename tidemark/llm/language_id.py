"""Language identification by rank-order n-gram profiles.

A text is lower-cased; every run of letters is a token, padded by one blank on either side, and its 1- to 3-grams are
counted. The ``top`` most frequent n-grams, in order of frequency, are a profile. A language's profile comes from all
n-grams of its learning texts; a document's distance to a language is the sum over the document's profile of how far
each n-gram is out of place there, with ``top`` for one that the language lacks. The nearest language wins.

Learning texts: rows with a language and outside the held-out fold, at most about ``sample_per_lang`` a language (a
hash of doc_id decides, so the choice doesn't depend on partitions). That bound is the only sampling.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; ties between languages go to the
smaller name; with no learning rows every text is ``und``. Score is 1 - distance / largest possible distance. One row
per input row; texts of any length are counted whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, map_texts, read, ship_package, slices

UNKNOWN = "und"
_BITS = 18  # a letter's number fits; three of them and a text's place in its batch fill 63 bits
_TEXTS = 256
_PIECE = 1 << 21


@lru_cache(maxsize=1)
def _letter_numbers() -> np.ndarray:
    """By code point: 0 for what is no letter, else a number from 2 on. 1 stands for the blank."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.cumsum(letter) + 1, 0).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram code, count) of at most _TEXTS texts, ordered by text and code."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    number = _letter_numbers()[points]
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), size)[: len(points)]
    letter = number > 0
    first = np.concatenate(([True], ~letter[:-1]))  # what follows a non-letter keeps that one as the blank before it
    stay = letter | ~first
    number, owner = np.where(letter, number, 1)[stay], owner[stay]
    if not len(number):
        return (np.empty(0, np.int64),) * 3
    number = np.concatenate(([1], number, [1]))
    owner = np.concatenate((owner[:1], owner, owner[-1:])) << (3 * _BITS)
    inside = number > 1
    one = owner[inside] | number[inside]
    # The separator after a text is its own; a blank that opens a token may belong to the text before, never after.
    two = (np.maximum(owner[:-1], owner[1:]) | (number[:-1] << _BITS) | number[1:])[inside[:-1] | inside[1:]]
    three = (owner[1:-1] | (number[:-2] << (2 * _BITS)) | (number[1:-1] << _BITS) | number[2:])[inside[1:-1]]
    key = np.concatenate((one, two, three))
    key.sort()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(edge, len(key)))
    key = key[edge]
    return key >> (3 * _BITS), key & ((1 << (3 * _BITS)) - 1), count


def _one_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the n-grams of one text, a piece at a time; two symbols go over to the next piece."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    carry = np.array([1], np.int64)
    for at in range(0, len(text), _PIECE):
        number = _letter_numbers()[np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        letter = number > 0
        stay = letter | np.concatenate(([carry[-1] > 1], letter[:-1]))  # of a run of non-letters the first
        last = [1] if at + _PIECE >= len(text) else []
        line = np.concatenate((carry, np.where(letter, number, 1)[stay], last)).astype(np.int64)
        inside, old = line > 1, len(carry)
        pair = np.arange(max(old, 1), len(line))
        pair = pair[inside[pair - 1] | inside[pair]]
        triple = np.arange(max(old, 2), len(line))
        triple = triple[inside[triple - 1]]
        made = np.concatenate((line[old:][inside[old:]], line[pair - 1] << _BITS | line[pair], line[triple - 2] << (2 * _BITS) | line[triple - 1] << _BITS | line[triple]))
        codes, place = np.unique(np.concatenate((codes, made)), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, np.ones(len(made)))), minlength=len(codes)).astype(np.int64)
        carry = line[-2:]
    return codes, counts


def counted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first text, text within block, code, count) that cover all texts."""
    lowered = [(t or "").lower() for t in texts]
    at = 0
    while at < len(lowered):
        if len(lowered[at]) > _PIECE:
            codes, counts = _one_long(lowered[at])
            yield at, np.zeros(len(codes), np.int64), codes, counts
            at += 1
            continue
        end = at
        total = 0
        while end < len(lowered) and end - at < _TEXTS and total + len(lowered[end]) <= _PIECE:
            total += len(lowered[end])
            end += 1
        yield (at, *grams(lowered[at:end]))
        at = end


def fit(docs: DataFrame, top: int = 300, sample_per_lang: int = 2000, most_langs: int = 1000) -> dict[str, np.ndarray]:
    """Profiles {language: codes by rank}. ``docs``: doc_id, text, lang, learning rows only. Of more than ``most_langs``
    languages, as a dirty column may hold, the most frequent are learned, so that the profiles stay bounded.

    What reaches the driver is at most ``top`` n-grams a language from each partition of the counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ship_package(docs.sparkSession)
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r["lang"]: r["n"] for r in found.collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_lang / n))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(2).to_pylist()
                for at, owner, codes, counts in counted(part.column(1).to_pylist()):
                    own = np.array(langs[at : at + _TEXTS], object)[owner]
                    for lang in set(own.tolist()):
                        mine = own == lang
                        code, place = np.unique(codes[mine], return_inverse=True)
                        sums = np.bincount(place, weights=counts[mine]).astype(np.int64)
                        into = total[lang]
                        for c, n in zip(code.tolist(), sums.tolist()):
                            into[c] += n
        for lang, into in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(into)), pa.array(list(into), pa.int64()), pa.array(list(into.values()), pa.int64())], names=["lang", "code", "n"]
            )

    counts = chosen.select("doc_id", "text", "lang").mapInArrow(count, "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        for batch in batches:
            for lang, code, n in zip(*(c.to_pylist() for c in batch.columns)):
                held[lang].append((-n, code))
            for lang, rows in held.items():
                held[lang] = sorted(rows)[:top]
        rows = [(lang, code, -n) for lang, own in held.items() for n, code in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "code", "n"])

    found: dict[str, list] = defaultdict(list)
    for r in counts.mapInArrow(best, "lang string, code long, n long").collect():
        found[r["lang"]].append((-r["n"], r["code"]))
    return {lang: np.array([c for _, c in sorted(rows)[:top]], np.int64) for lang, rows in sorted(found.items())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.top, self.langs = top, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        for at, owner, codes, counts in counted(texts):
            if not len(owner):
                continue
            most = int(counts.max())
            by = np.argsort(owner * (most + 1) + (most - counts), kind="stable")  # equal counts stay in order of code
            owner, codes = owner[by], codes[by]
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            short = place < self.top
            owner, codes, place = owner[short], codes[short], place[short]
            found = np.searchsorted(self.codes, codes)
            found[found == len(self.codes)] = 0
            found = np.where(self.codes[found] == codes, found, len(self.codes))
            rank = self.rank[found]
            off = np.where(rank < 0, self.top, np.abs(rank - place[:, None]))
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            distance = np.add.reduceat(off, start, axis=0)
            size = np.diff(np.append(start, len(owner)))
            nearest = distance.argmin(axis=1)
            closeness = 1 - distance[np.arange(len(start)), nearest] / (self.top * size)
            for who, k, s in zip(owner[start].tolist(), nearest.tolist(), closeness.tolist()):
                names[at + who], scores[at + who] = self.langs[k], min(1.0, max(0.0, s))
        return names, scores


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = 300, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score. The profiles travel with the task: top n-grams for each language."""

    def make() -> Callable[[list], dict]:
        model = Profiles(profiles, top)

        def run(texts: list) -> dict:
            names, scores = model.predict(texts)
            return {"lang_pred": names, "score": scores}

        return run

    return map_texts(docs, keep, make, "lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out())
    profiles = fit(docs.where(~F.col("held_out")))
    return predict(docs, profiles, keep=("doc_id", "held_out"))

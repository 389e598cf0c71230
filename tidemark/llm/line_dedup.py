"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

Lines are sets of words. Words are ordered by rarity over all data; two sets whose Jaccard similarity reaches the
threshold share one of the first n - ceil(t n) + 1 words of each. Those prefix words meet by shard; within a word's
list pairs pass the length filter, the positional filter (what follows the shared word must suffice for the overlap)
and a parity filter (a 128-bit sketch bounds how many words differ from below; it never drops a true pair). Each line's
closest candidate, by sketch, is verified on the full sets first, the others only if that one fails. A line goes if an
earlier line, by (doc_id, line number), matches it, whether or not that one stays; equal lines match with no pair made
of them.

The question is only whether a line has an earlier match, so a word's list is walked from its earliest line on, and a
line leaves the walk with ``earliest`` candidates, of which one whose sketch differs in half of what is allowed or
less counts ``strong`` times: a group of near copies costs a few pairs a line, not all pairs.
A line that left with more to come, and none of whose candidates was verified, comes up in a second round, in which
nothing is held back. So no match is lost.

Rarity: counts over all data of the words that a partition holds ``floor`` times or more; of these the ``heavy`` most
frequent, a fixed number, travel with the tasks as classes by the logarithm of their counts. Every other word ranks as
rarer, in order of its hash. Any fixed order gives the same result; a better one only gives fewer candidates. So a task
that has met ``counted`` different words may forget the rarest of them.

Equal lines are told by 128 bits of their bytes; sets are compared by 48 bits of each word. In a pair that passed the
filters, two different words of 50 agree there with a chance of about 1e-11.

Defined results: lines with fewer than ``min_words`` words stay; a null text stays null, an empty one empty. Rows
without doc_id have no order: their lines stay and match nothing. Rows that repeat a doc_id with the same text are one
to the rule. Texts of any length are taken whole; empty tables give empty ones; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, cut, map_texts, read, released, ship_package, shuffle_width, slices

_CLASS = np.uint64(59)
_HASH = np.uint64((1 << 59) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 16 << 20
#: A prefix word of a line on its way to its shard. The word's hash beyond what chose the shard is cut to 32 bits: words
#: that clash there only make candidates. A size or place that doesn't fit is _MANY, for which no filter applies.
_ROW = np.dtype([("word", "<u4"), ("line", "<i8"), ("doc", "<i8"), ("number", "<u4"), ("size", "<u2"), ("place", "<u2"), ("sketch", "<u8"), ("other", "<u8")])
_MANY = 65535
#: Sets travel to verification as so many low bytes of their words' hashes.
_BYTES = 6


def _pack(rows: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Rows column by column, in order of document, compressed."""
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    return squeeze.compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _ROW.names))


def _unpack(packed: bytes, squeeze: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = squeeze.decompress(packed)
    rows = np.empty(len(raw) // _ROW.itemsize, _ROW)
    at = 0
    for f in _ROW.names:
        size = len(rows) * _ROW[f].itemsize
        rows[f] = np.frombuffer(raw[at : at + size], _ROW[f])
        at += size
    return rows


def filter_bits(items: int) -> int:
    """Bits of a bitmap over so many items: about eight each, and 32 MB at most. A full one only lets more through."""
    return 1 << min(28, max(20, (8 * items).bit_length()))


@dataclass(frozen=True)
class Rule:
    """Jaccard threshold num / den; lines under min_words words are left alone.

    With ``shingle`` a whole text, A-Z lower-cased, is one line, and its members are runs of so many words (of all its
    words, if they are fewer). Such sets outgrow a sketch, so theirs covers a share of the members: it names the closest
    candidate, but filters nothing.
    """

    num: int = 4
    den: int = 5
    min_words: int = 1
    earliest: int = 256
    strong: int = 32
    floor: int = 8
    heavy: int = 1 << 17
    counted: int = 1 << 20
    shingle: int = 0

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size + (-self.num * size) // self.den + 1

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least number of shared words of two sets of these sizes at the threshold."""
        return -((-self.num * (a + b)) // (self.num + self.den))


def graded(hashes: np.ndarray, heavy: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Word hashes with their class of frequency on top."""
    if not len(heavy):
        return hashes
    found = np.searchsorted(heavy, hashes)
    found[found == len(heavy)] = 0
    return hashes | np.where(heavy[found] == hashes, grade[found], 0).astype(np.uint64) << _CLASS


_known_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; kept for the next call."""
    global _known_powers
    if len(_known_powers[0]) < n:
        size = max(n, 3 << 19)
        both = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64)))]
        _known_powers = (both[0], both[1])
    return _known_powers


class Lines:
    """The lines of a list of UTF-8 texts and the hashes of their words, found by array operations over all bytes at once."""

    def __init__(self, texts: list[bytes | None], rule: Rule):
        encoded = [t or b"" for t in texts]
        if rule.shingle:
            encoded = [t.lower().replace(b"\n", b" ") for t in encoded]
        self.raw = b"\n".join(encoded)
        byte = np.frombuffer(self.raw, np.uint8)
        blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
        newline = byte == 10
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1 if len(byte) else np.empty(0, np.int64)
        bounds = np.concatenate(([0] if len(byte) and not blank[0] else [], edge, [len(byte)] if len(byte) and not blank[-1] else [])).astype(np.int64)
        start = bounds[0::2]
        line = np.cumsum(newline, dtype=np.int32)[start] if len(start) else np.empty(0, np.int32)
        at = np.flatnonzero(newline)
        self.begin, self.end = np.append(0, at + 1), np.append(at, len(byte))
        inner = np.fromiter((e.count(b"\n") + 1 for e in encoded), np.int64, len(encoded))
        self.text = np.repeat(np.arange(len(encoded)), inner)
        self.number = np.arange(len(self.begin)) - np.repeat(np.cumsum(inner) - inner, inner)
        words = np.bincount(line, minlength=len(self.begin))
        self.eligible = np.flatnonzero(words >= rule.min_words)
        self._start, self._stop, self._line, self._byte = start, bounds[1::2], line, byte
        self._shingle, self._word_line = rule.shingle, line
        if rule.shingle:  # one line a document: its hash settles the order of documents that share a doc_id
            self.number = np.fromiter((xxhash.xxh64_intdigest(t) & 0x7FFFFFFF for t in encoded), np.int64, len(encoded))
            place = np.arange(len(line)) - np.repeat(np.cumsum(words) - words, words)
            self._run = np.flatnonzero(place <= np.maximum(np.repeat(words, words) - rule.shingle, 0))
            self._line = line[self._run]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the eligible lines' bytes, in two halves; the first half is a line's id."""
        digest, raw = xxhash.xxh3_128_digest, memoryview(self.raw)
        spans = zip(self.begin[self.eligible].tolist(), self.end[self.eligible].tolist())
        both = np.frombuffer(b"".join(digest(raw[a:z]) for a, z in spans), np.int64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def bytes_of(self, chosen: np.ndarray) -> list[bytes]:
        return [self.raw[a:z] for a, z in zip(self.begin[chosen].tolist(), self.end[chosen].tolist())]

    def words(self) -> np.ndarray:
        """59-bit hashes of all words (shingles) in order."""
        start, stop = self._start, self._stop
        if not len(start):
            return np.empty(0, np.uint64)
        power, inverse = powers(len(self._byte) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(self._byte * power[: len(self._byte)])
            sums = np.concatenate((np.zeros(1, np.uint64), sums))
            sums = (sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        sums = (sums ^ (sums >> np.uint64(31))) >> np.uint64(5)
        return self._shingled(sums) if self._shingle else sums

    def _shingled(self, words: np.ndarray) -> np.ndarray:
        at, last = self._run, len(words) - 1
        sums = words[at]
        with np.errstate(over="ignore"):
            for ahead in range(1, self._shingle):
                to = np.minimum(at + ahead, last)
                inside = (at + ahead <= last) & (self._word_line[to] == self._line)
                sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.where(inside, words[to] + np.uint64(1), np.uint64(0))
            sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (sums ^ (sums >> np.uint64(31))) >> np.uint64(5)

    def having(self, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The lines with a word whose hash passes a test."""
        return np.unique(self._line[test(self.words())])

    def sets(self, chosen: np.ndarray, heavy: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word codes of the chosen lines (ascending indexes), rarest first, end to end, and their numbers.

        A code is a word's class of frequency (``heavy`` hashes, sorted, with their ``grade``; 0 for all others) over
        its hash, so the order of codes is the order of rarity.
        """
        wanted = np.full(len(self.begin), -1, np.int64)
        wanted[chosen] = np.arange(len(chosen))
        codes, owner = self.words(), wanted[self._line]
        codes, owner = codes[owner >= 0], owner[owner >= 0]
        if not len(codes):
            return codes, np.zeros(len(chosen), np.int64)
        order = np.argsort(codes)
        codes = codes[order]
        new = np.concatenate(([True], codes[1:] != codes[:-1]))
        rank = np.cumsum(new) - 1
        values = codes[new]
        if len(heavy):
            values = graded(values, heavy, grade)
            by = np.argsort(values)
            turn = np.empty(len(values), np.int64)
            turn[by] = np.arange(len(values))
            values, rank = values[by], turn[rank]
        key = owner[order] << 32 | rank
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return values[key & 0xFFFFFFFF], np.bincount(key >> 32, minlength=len(chosen))


def heavy_words(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, classes) of at most ``rule.heavy`` frequent words, by hash; class 1 + log2(count), 31 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def fold(most: int = 0) -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate(held)
            every.sort()
            edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            both = np.concatenate((word, every[edge]))
            sums = np.concatenate((total, np.diff(np.append(edge, len(every)))))
            order = np.argsort(both)
            both, sums = both[order], sums[order]
            edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            held.clear()
            both, sums = both[edge], np.add.reduceat(sums, edge)
            least = 1
            while most and len(both) > most:  # memory is bounded; a forgotten word counts as rarer than it is
                least *= 2
                both, sums = both[sums >= least], sums[sums >= least]
            return both, sums

        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).cast(pa.binary()).to_pylist()
                if len(own := Lines(texts, rule).words()):
                    held.append(own)
                if sum(map(len, held)) > 1_000_000:
                    word, total = fold(rule.counted)
        if held:
            word, total = fold()
        often = total >= rule.floor
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(total[often])], names=["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = sorted((r["word"], min(31, r["n"].bit_length())) for r in counts.orderBy(F.desc("n"), "word").limit(rule.heavy).collect())
    return np.array([w for w, _ in top], np.uint64), np.array([c for _, c in top], np.uint64)


def _share(size: np.ndarray) -> np.ndarray:
    """A sketch of 64 bits over a set of this size takes one member of 2^k, about 48 of them."""
    return np.maximum(0, np.frexp(size / 48)[1])


def _prefixes(docs: DataFrame, rule: Rule, heavy: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """(shard, rows): the prefix words of all distinct lines, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> Iterator[pa.RecordBatch]:
            shard, rows = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(shard, kind="stable")
            shard, rows = shard[order], rows[order]
            start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            stop = np.append(start[1:], len(rows))
            for at in range(0, len(start), 64):
                part = slice(at, at + 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[start[part]].astype(np.int32)), pa.array([_pack(rows[a:z], squeeze) for a, z in zip(start[part], stop[part])], pa.binary())],
                    names=["shard", "rows"],
                )

        for batch in batches:
            for part in slices(batch, 1):
                lines = Lines(part.column(1).cast(pa.binary()).to_pylist(), rule)
                if not len(lines.eligible):
                    continue
                ids, doc = lines.ids()[0], part.column(0).to_numpy(zero_copy_only=False)[lines.text[lines.eligible]]
                order = np.lexsort((lines.number[lines.eligible], doc, ids))  # a line stands for itself where it is earliest
                once = np.sort(order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))])
                ids = ids[once]
                codes, size = lines.sets(lines.eligible[once], *heavy)
                stop = np.cumsum(size)
                start = stop - size
                rows = np.empty(int((length := rule.prefix(size)).sum()), _ROW)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
                word = (codes[np.repeat(start, length) + place] & _HASH) * _ODD
                rows["word"] = word & np.uint64(0xFFFFFFFF)
                rows["place"] = np.minimum(place, _MANY)
                rows["size"] = np.repeat(np.minimum(size, _MANY), length)
                rows["line"] = np.repeat(ids, length)
                rows["doc"] = np.repeat(doc[once], length)
                rows["number"] = np.repeat(lines.number[lines.eligible[once]], length)
                bit, side = np.uint64(1) << (codes & np.uint64(63)), codes >> np.uint64(6) & np.uint64(1)
                if rule.shingle:
                    share = np.repeat(np.uint64(1) << _share(size).astype(np.uint64), size)
                    side = (codes >> np.uint64(6) & (share - np.uint64(1)) != 0).astype(np.uint64)
                for half, name in ((0, "sketch"), (1, "other")):
                    rows[name] = np.repeat(np.bitwise_xor.reduceat(np.where(side == half, bit, np.uint64(0)), start), length)
                if rule.shingle:
                    rows["other"] = 0
                held.append(((word >> np.uint64(32)) % np.uint64(shards), rows))
                if sum(r.nbytes for _, r in held) > _FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "shard int, rows binary")


def _meet(rows: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among the prefix rows of one shard: line, earlier line, how far their sketches are apart, -1; and for
    every line that left a list's walk early: line, -1, -1, the word's cut hash."""
    rank = np.empty(len(rows), np.int64)
    rank[_by_place(rows["doc"], rows["number"])] = np.arange(len(rows))
    rows = rows[np.argsort(rows["word"].astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64))]
    same = rows["line"].astype(np.uint64) * _ODD ^ (rows["word"] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(same)
    edge = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
    rows = rows[np.sort(np.minimum.reduceat(order, edge))]  # a line of several partitions stands where it is earliest
    word, line, size, sketch, more = (np.ascontiguousarray(rows[c]) for c in ("word", "line", "size", "sketch", "other"))
    size = size.astype(np.int64)
    share = _share(size)
    rest = np.where(size == _MANY, 1 << 60, size - rows["place"])
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    first = np.repeat(start, np.diff(np.append(start, len(word))))
    hits = np.zeros(len(rows), np.int64)
    live = np.flatnonzero(first < np.arange(len(rows)))
    found, step = [], 0
    while len(live):  # every line meets the earliest of its word's list, then the next, up to itself
        other = first[live] + step
        go = other < live
        live, other = live[go], other[go]
        a, b = size[live], size[other]
        fit = np.flatnonzero((rule.num * np.maximum(a, b) <= rule.den * np.minimum(a, b)) | (np.maximum(a, b) == _MANY))
        at, to, a, b = live[fit], other[fit], a[fit], b[fit]
        need, many = rule.overlap(a, b), np.maximum(a, b) == _MANY
        fit = np.flatnonzero(many | (np.minimum(rest[at], rest[to]) >= need))
        at, to, may, many = at[fit], to[fit], (a + b - 2 * need)[fit], many[fit]
        apart = np.bitwise_count(sketch[at] ^ sketch[to]).astype(np.int64) + np.bitwise_count(more[at] ^ more[to])
        if rule.shingle:  # a share of the members: what it says is likely, not sure
            may, apart = may >> share[at], np.where((share[at] == share[to]) & ~many, apart, 64)
        else:
            good = many | (apart <= may)
            at, to, may, apart = at[good], to[good], may[good], apart[good]
        found.append((at, to, apart))
        hits[at] += np.where(2 * apart <= may, rule.strong, 1)
        live = live[hits[live] < rule.earliest]
        step += 1
    if not found:
        return (np.empty(0, np.int64),) * 4
    at, other, apart = map(np.concatenate, zip(*found))
    one, two = line[at], line[other]
    order = np.lexsort((apart, two, one))
    one, two, apart = one[order], two[order], apart[order]
    once = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) & (one != two) if len(one) else np.empty(0, bool)
    one, two, apart = one[once], two[once], apart[once]
    early = np.flatnonzero(hits >= rule.earliest)
    none = np.full(max(len(one), len(early)), -1)
    return np.append(one, line[early]), np.append(two, none[: len(early)]), np.append(apart, none[: len(early)]), np.append(none[: len(one)], word[early])


def _by_place(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order of (doc, number); by one key where both fit into it."""
    low, wide = int(doc.min(initial=0)), int(number.max(initial=0)) + 1
    if (int(doc.max(initial=0)) - low + 1) * wide < 1 << 62:
        return np.argsort((doc - low) * wide + number)
    return np.lexsort((number, doc))


def _held(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids & ((len(bitmap) - 4096) * 8 - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _candidates(packed: DataFrame, rule: Rule) -> DataFrame:
    """(line, earlier, apart, list): pairs that pass all filters, list null; and the lists that a line left early,
    earlier null. A pair comes once for each shard in which it meets."""
    packed = packed.repartition(shuffle_width(packed.sparkSession), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []
        now = None

        def solve() -> pa.RecordBatch:
            line, earlier, apart, word = _meet(np.concatenate(held), rule)
            held.clear()
            columns = [pa.array(line), pa.array(earlier, mask=word >= 0), pa.array(apart.astype(np.int32), mask=word >= 0), pa.array(now << 32 | word, mask=word < 0)]
            return pa.RecordBatch.from_arrays(columns, names=["line", "earlier", "apart", "list"])

        for batch in batches:
            for shard, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if held and shard != now:
                    yield solve()
                now = shard
                held.append(_unpack(rows, squeeze))
        if held:
            yield solve()

    return packed.mapInArrow(run, "line long, earlier long, apart int, list long")


def _filter_of(ids: DataFrame, column: str) -> bytes:
    """A bitmap over ids, which are hashes: built on executors, bounded in size, no false negatives."""
    bits = filter_bits(ids.count())
    place = F.pmod(F.col(column), F.lit(bits)) + 1  # the bitmap functions count from 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _bytes(codes: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's codes, _BYTES bytes a code."""
    raw, stop = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes(), np.cumsum(size) * _BYTES
    return [raw[a:z] for a, z in zip((stop - size * _BYTES).tolist(), stop.tolist())]


def _occurrences(docs: DataFrame, rule: Rule, flagged: bytes) -> DataFrame:
    """(doc_id, key, line_no, line, check, codes) of all eligible lines; codes only where the filter may hold the line.
    (line, check) are the 128 bits that tell lines apart."""
    none = np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(flagged, np.uint8)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                lines = Lines(texts, rule)
                own = lines.eligible
                if not len(own):
                    continue
                keys = np.fromiter((xxhash.xxh64_intdigest(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
                ids, check = lines.ids()
                hit = np.flatnonzero(_held(bitmap, ids))
                codes, size = Lines(lines.bytes_of(own[hit]), rule).sets(np.arange(len(hit)), none, none)
                sets: list[bytes | None] = [None] * len(own)
                for i, raw in zip(hit.tolist(), _bytes(codes, size)):
                    sets[i] = raw
                text = lines.text[own]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text)), pa.array(keys[text]), pa.array(lines.number[own].astype(np.int32)), pa.array(ids), pa.array(check), pa.array(sets, pa.binary())],
                    names=["doc_id", "key", "line_no", "line", "check", "codes"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, line_no int, line long, check long, codes binary")


def _lists(docs: DataFrame, rule: Rule, heavy: tuple[np.ndarray, np.ndarray], shards: int, wanted: bytes) -> DataFrame:
    """(list, line, doc_id, line_no, codes): the members of the word lists that a bitmap may hold. Only lines with
    a word of such a list are taken further than their words' hashes."""

    def named(codes: np.ndarray) -> np.ndarray:
        word = (codes & _HASH) * _ODD
        return ((word >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | word & np.uint64(0xFFFFFFFF)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            for part in slices(batch, 1):
                lines = Lines(part.column(1).cast(pa.binary()).to_pylist(), rule)
                if not len(lines.eligible):
                    continue
                own = np.intersect1d(lines.eligible, lines.having(lambda words: _held(bitmap, named(words))))
                if not len(own):
                    continue
                few = Lines(lines.bytes_of(own), rule)
                codes, size = few.sets(np.arange(len(own)), *heavy)
                stop = np.cumsum(size)
                length = rule.prefix(size)
                owner = np.repeat(np.arange(len(size)), length)
                name = named(codes[np.repeat(stop - size, length) + np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)])
                hit = _held(bitmap, name)
                name, owner = name[hit], owner[hit]
                sets = _bytes(codes, size)
                columns = [
                    pa.array(name),
                    pa.array(few.ids()[0][owner]),
                    part.column(0).take(pa.array(lines.text[own[owner]])),
                    pa.array(lines.number[own[owner]].astype(np.int32)),
                    pa.array([sets[k] for k in owner.tolist()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "line", "doc_id", "line_no", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, "list long, line long, doc_id long, line_no int, codes binary")


def _verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(line) of the rows (line, x, y) whose sets x and y reach the threshold; a line may come up more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                both = np.zeros((len(x) + len(y)) // _BYTES, np.uint64)
                both.view(np.uint8).reshape(-1, 8)[:, :_BYTES] = np.frombuffer(x + y, np.uint8).reshape(-1, _BYTES)
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(rule.den * shared >= rule.num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["line"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("line", "x", "y").mapInArrow(run, "line long")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    own = sets.select("line", "codes")
    return pairs.join(own.withColumnsRenamed({"codes": "x"}), "line").join(own.withColumnsRenamed({"line": "earlier", "codes": "y"}), "earlier")


def removed_lines(docs: DataFrame, rule: Rule = Rule(), shards_per_task: int = 4, likely: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, gone array<int>): the line numbers to remove, for rows that lose any; key is the text's hash.

    ``likely`` has pairs (line, earlier) from elsewhere. They are verified first; a line that one of them settles asks no more.
    Every step is a table, so that its shuffle files go before the next begins; the tables go at the end.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    heavy, shards = heavy_words(docs, rule), shards_per_task * shuffle_width(spark)
    with released(spark, "lines-gone"):
        found = cut(_candidates(_prefixes(docs, rule, heavy, shards), rule), "lines-found")
        pairs = cut(found.where("earlier is not null").groupBy("line", "earlier").agg(F.min("apart").alias("apart")), "lines-pairs")
        ends = _ends(pairs) if likely is None else _ends(pairs).union(_ends(likely))
        lines = cut(_occurrences(docs, rule, _filter_of(ends, "line")), "lines-all")
        sets = cut(lines.where("codes is not null").groupBy("line").agg(F.first("codes").alias("codes")), "lines-sets")
        if likely is not None:
            settled = cut(_verified(_with_sets(likely, sets), rule), "lines-settled")
            pairs = pairs.join(settled, "line", "left_anti")
        closest = pairs.groupBy("line").agg(F.min(F.struct("apart", "earlier"))["earlier"].alias("earlier"))
        known = cut(_verified(_with_sets(closest, sets), rule), "lines-known")
        others = pairs.join(known, "line", "left_anti").join(closest, ["line", "earlier"], "left_anti")
        known = known.union(_verified(_with_sets(others, sets), rule))
        known = cut((known if likely is None else known.union(settled)).distinct(), "lines-known")
        left = cut(found.where("list is not null").select("line", "list").distinct().join(known, "line", "left_anti"), "lines-left")
        if not left.isEmpty():
            known = known.union(_second_round(docs, left, rule, heavy, shards)).distinct()
        place = F.struct("doc_id", "key", "line_no")
        first = lines.groupBy("line", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        bound = first.join(known.withColumn("all", F.lit(True)), "line", "left").where("all or n > 1").select("line", "check", "first", "all")
        gone = lines.select("line", "check", "doc_id", "key", "line_no").join(bound, ["line", "check"]).where(F.col("all") | (place > F.col("first")))
        return cut(gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone")), "lines-gone")


def _second_round(docs: DataFrame, left: DataFrame, rule: Rule, heavy: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """(line) of the lines in ``left`` (line, list) that match an earlier member of the list, nothing held back."""
    members = _lists(docs, rule, heavy, shards, _filter_of(left.select("list").distinct(), "list"))
    members = cut(members.join(left.select("list").distinct(), "list", "left_semi").withColumn("n", F.expr(f"length(codes) DIV {_BYTES}")), "lines-members")
    own = F.min(F.struct("doc_id", "line_no", "codes", "n")).alias("own")  # a line stands where it is earliest
    asking = members.join(left, ["list", "line"], "left_semi").groupBy("list", "line").agg(own)
    asking = asking.select("list", "line", F.struct("own.doc_id", "own.line_no").alias("at"), F.col("own.codes").alias("x"), F.col("own.n").alias("a"))
    asked = members.select(F.col("list").alias("in"), F.col("line").alias("earlier"), F.struct("doc_id", "line_no").alias("before"), F.col("codes").alias("y"), F.col("n").alias("b"))
    fits = f"{rule.num} * greatest(a, b) <= {rule.den} * least(a, b)"
    meet = (F.col("list") == F.col("in")) & (F.col("before") < F.col("at")) & (F.col("line") != F.col("earlier")) & F.expr(fits)
    return _verified(asking.join(asked, meet), rule)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("line").union(pairs.select("earlier"))


def dedup_lines(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All rows and columns of ``docs`` with the removed lines cut from text, and n_lines_removed (in place of a column of
    that name)."""
    left = _deduped(docs, rule)
    return left.select(*[c for c in docs.columns if c != "n_lines_removed"], F.col("__lost").alias("n_lines_removed"))


def _deduped(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` without removed lines, and __lost, how many went."""
    gone = removed_lines(docs, rule)
    own = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*own).alias("__own"), F.col("doc_id").cast("long").alias("__doc"), "text")

    def make() -> Callable[[list], dict]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def run(texts: list) -> dict:
            raw = [t.encode() if t is not None else None for t in texts]
            keys = np.fromiter((xxhash.xxh64_intdigest(r or b"") for r in raw), np.uint64, len(raw)).view(np.int64)
            return {"__key": keys, "__packed": [squeeze.compress(r) if r is not None else None for r in raw]}

        return run

    packed = map_texts(carried, ("__own", "__doc"), make, "__key long, __packed binary")
    gone = gone.withColumnsRenamed({"doc_id": "__doc", "key": "__key", "gone": "__gone"})
    joined = packed.join(gone, ["__doc", "__key"], "left").select("__own", "__packed", "__gone")
    schema = joined.select("__own").schema.add("text", "string").add("__lost", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 1):
                texts, counts = [], []
                for packed, lost in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = squeeze.decompress(packed).decode() if packed is not None else None
                    if lost:
                        lost = set(lost)
                        text = "\n".join(line for at, line in enumerate(text.split("\n")) if at not in lost)
                    texts.append(text)
                    counts.append(len(lost or ()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["__own", "text", "__lost"])

    made = joined.mapInArrow(run, schema)
    return made.select(*[F.col("text") if c == "text" else F.col("__own")[c].alias(c) for c in docs.columns], "__lost")


def keep_first_lines(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without later matches of lines, same columns; a document that loses its last word goes as a whole."""
    left = _deduped(docs, rule)
    return left.where((F.col("__lost") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines_removed and the SHA-256 of what is left of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

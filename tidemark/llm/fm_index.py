"""A compressed full-text index over word sequences: Burrows-Wheeler transform in a wavelet matrix, backward search.

The text itself is not kept. Ranks come from bit vectors of n log(words) bits with one count per 64 bits; document
order per suffix, for the question whether a match lies in an earlier document, from range minima of about 13 bytes a
word. Of a document's matching statistics only what the threshold asks is worked out: whether the match at a place is
at least a window long, not how much longer.
"""

from __future__ import annotations

import numpy as np

#: So few segments left are finished window by window, all windows at once, rather than each in its own time.
_FEW = 512


class WaveletMatrix:
    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        n = len(sequence)
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(128 - n % 64, bit.dtype)).astype(np.uint8), bitorder="little")
            words = packed[: len(packed) // 8 * 8].view(np.uint64)
            self.words.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32))
            set_ = bit == 1
            self.zeros.append(n - int(set_.sum()))
            sequence = np.concatenate((sequence[~set_], sequence[set_]))
        self.start = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Segments (arrays of symbols from 1 on, laid end to end) with an owner number each, owners in ascending order."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray, owner: np.ndarray, alphabet: int):
        stop = np.cumsum(size)
        count = len(size)
        n = len(symbols) + count
        text = np.zeros(n, np.int64)
        word = np.ones(n, bool)
        word[stop + np.arange(count)] = False
        text[word] = symbols
        order = _suffixes(text, ~word)
        before = text[order - 1]  # of the first suffix, the last separator
        self.first = np.searchsorted(text[order], np.arange(alphabet + 1))
        self.matrix = WaveletMatrix(before, alphabet + 1)
        self.n = n
        place = np.cumsum(~word) - (~word)
        self.least = Minima(owner[np.minimum(place, count - 1)][order].astype(np.int32))

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least owner in each range of suffixes; ranges are not empty."""
        return self.least.of(low, high)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of matches with each symbol put before them."""
        m = len(symbol)
        rank = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.first[symbol] + rank[:m], self.first[symbol] + rank[m:]


def _suffixes(text: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; every separator is a symbol of its own, so all ranks part in the end."""
    n = len(text)
    rank = np.where(separator, np.cumsum(separator) - 1, text + separator.sum())
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2 + int(text.max(initial=0))) + after
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Minima:
    """Range minima: runs of 1, 4 and 16 values from every place on, and a table over whole blocks for long ranges. A range
    of under 64 is covered by four runs, a longer one by four at either end and the blocks between."""

    BLOCK = 64

    def __init__(self, values: np.ndarray):
        self.runs = [values]
        for span in (1, 4):  # four runs of one size make one of the next
            last = self.runs[-1]
            row = last.copy()
            for k in (1, 2, 3):
                if k * span < len(last):
                    row[: -k * span] = np.minimum(row[: -k * span], last[k * span :])
            self.runs.append(row)
        blocks = len(values) // self.BLOCK
        self.rows = [values[: blocks * self.BLOCK].reshape(blocks, self.BLOCK).min(axis=1)] if blocks else []
        span = 1
        while span * 2 <= blocks:
            self.rows.append(np.minimum(self.rows[-1][:-span], self.rows[-1][span:]))
            span *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of [low, high), none of them empty."""
        size = high - low
        least = np.empty(len(low), self.runs[0].dtype)
        for row, span in zip(self.runs, (1, 4, 16)):
            at = np.flatnonzero((size >= span) & (size < 4 * span))
            if len(at):
                a, z = low[at], high[at] - span
                first = np.minimum(row[a], row[z])
                least[at] = np.minimum(first, np.minimum(row[np.minimum(a + span, z)], row[np.minimum(a + 2 * span, z)]))
        far = np.flatnonzero(size >= self.BLOCK)
        if len(far):
            a, z, row = low[far], high[far] - 16, self.runs[2]
            own = np.minimum(row[a], row[z])
            for k in (16, 32, 48):
                own = np.minimum(own, np.minimum(row[a + k], row[z - k]))
            first, stop = -(-a // self.BLOCK), high[far] // self.BLOCK
            inner = np.flatnonzero(stop > first)
            level = np.frexp((stop - first)[inner].astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = inner[level == k]
                table = self.rows[k]
                own[at] = np.minimum(own[at], np.minimum(table[first[at]], table[stop[at] - (1 << k)]))
            least[far] = own
        return least


def matched_windows(codes: np.ndarray, size: np.ndarray, owner: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each segment the ranges [first, last) of starts of ``window`` words that an earlier owner's segment holds.

    ``owner`` ascends. All segments are streamed against the index side by side, one backward step each a round. A
    probe asks whether the words of [i, b) occur in an earlier owner; where it stops short, at word p, no window that
    holds [p, b) matches, so the next start is p + 1 for a probe of one window, and a longer one is halved.
    """
    alphabet, dense = np.unique(codes, return_inverse=True)
    symbols = dense.astype(np.int64) + 1
    index = FMIndex(symbols, size, owner, len(alphabet))
    base = np.cumsum(size) - size
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(size))]
    who = np.flatnonzero(size >= window)
    i = np.zeros(len(size), np.int64)
    end = size.copy()  # windows that end later are known not to match
    probe = size.copy()
    at = size.copy()  # the probe has matched [at, probe)
    low = np.zeros(len(size), np.int64)
    high = np.full(len(size), index.n, np.int64)
    while len(who) > _FEW:
        at[who] -= 1
        symbol = symbols[base[who] + at[who]]
        lo, hi = index.extend(symbol, low[who], high[who])
        alive = hi > lo
        alive[alive] = index.earliest(lo[alive], hi[alive]) < owner[who[alive]]
        low[who], high[who] = lo, hi
        done = alive & (at[who] == i[who])
        ended = who[done | ~alive]
        good = done[done | ~alive]
        if not len(ended):
            continue
        win = ended[good]
        for k, a, b in zip(win.tolist(), i[win].tolist(), (probe[win] - window + 1).tolist()):
            found[k].append((a, b))
        i[win] = probe[win] - window + 1
        probe[win] = end[win]
        lose, p = ended[~good], at[ended[~good]]
        single = probe[lose] == i[lose] + window
        one = lose[single]
        i[one] = p[single] + 1
        late = p >= size[lose] - window  # no window starts behind the break
        end[lose[late]] = np.minimum(end[lose[late]], probe[lose[late]] - 1)
        many, p = lose[~single], p[~single]
        part = p < probe[many] - window  # windows behind the break match though the probe as a whole does not
        for k, a, b in zip(many[part].tolist(), (p[part] + 1).tolist(), (probe[many[part]] - window + 1).tolist()):
            found[k].append((a, b))
        probe[many] = i[many] + window + (probe[many] - i[many] - window) // 2
        probe[many] = np.minimum(probe[many], np.maximum(end[many], i[many] + window))
        probe[one] = end[one]
        at[ended] = probe[ended]
        low[ended], high[ended] = 0, index.n
        over = ended[i[ended] + window > end[ended]]
        if len(over):
            who = who[~np.isin(who, over)]
    rest = np.maximum(0, end[who] - window + 1 - i[who])
    segment = np.repeat(who, rest)
    start = np.arange(len(segment)) - np.repeat(np.cumsum(rest) - rest, rest) + i[segment]
    for k, a, b in _single(index, symbols, base, owner, segment, start, window):
        found[k].append((a, b))
    return found


def _single(index: FMIndex, symbols: np.ndarray, base: np.ndarray, owner: np.ndarray, segment: np.ndarray, start: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Ranges (segment, first, last) of the given windows that match, each window probed by itself, all side by side."""
    low, high = np.zeros(len(segment), np.int64), np.full(len(segment), index.n, np.int64)
    for back in range(window - 1, -1, -1):
        if not len(segment):
            return []
        lo, hi = index.extend(symbols[base[segment] + start + back], low, high)
        alive = hi > lo
        alive[alive] = index.earliest(lo[alive], hi[alive]) < owner[segment[alive]]
        segment, start, low, high = segment[alive], start[alive], lo[alive], hi[alive]
    if not len(segment):
        return []
    edge = np.flatnonzero((segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.append(0, edge), np.append(edge, len(segment)) - 1
    return list(zip(segment[first].tolist(), start[first].tolist(), (start[last] + 1).tolist()))

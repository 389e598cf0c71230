"""BPE encoding and decoding through a pair occurrence index.

The distinct pieces of a batch of texts are laid end to end as one array of symbols, linked to their neighbours. An
index maps each mergeable pair, by its rank, to all its positions in that array. Ranks are then taken in ascending
order from a heap of active ranks: all live positions of the pair merge at once, and the pairs that the merges create
join the lists of their own, always higher, ranks. Every numpy step handles all positions of one pair.

Which characters are letters, numbers or spaces, and how they are lower-cased, the library's own components say, asked
once on the driver for every code point (``character_classes``): Unicode tables of other modules are of other versions.

Defined results: a null text counts as empty (0 tokens, empty strings). Texts of any length are encoded whole; memory
is bounded by one text and the piece cache (``cache_bytes``, then emptied). Repeated rows give repeated rows; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, ship_package

_NEVER = np.int32(2**31 - 1)
_ENTRY = 250  # bytes that a piece takes in the cache besides its characters
_SLICE = 4 << 20  # one index serves so much text; each active rank costs some numpy calls an index


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _basic(kind: str) -> str:
    """The part of a class below U+10000, which ``re`` looks up in a table; further ranges it would try one by one."""
    return "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", kind) if r[2:6] == "0000")


def _class(chosen: np.ndarray) -> str:
    """What stands between the brackets of a regular expression for the code points that are set."""
    chosen = np.insert(chosen, 1 << 16, False)  # no range runs across
    edge = np.flatnonzero(np.diff(np.concatenate(([0], chosen.astype(np.int8), [0]))))
    edge -= edge > 1 << 16
    return "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in edge.reshape(-1, 2).tolist())


@functools.cache
def character_classes() -> dict[str, str]:
    """letter, number, space: the library's; odd: code points that Python composes or lower-cases in another way."""
    from tokenizers import Regex, normalizers

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    text = "".join(map(chr, points.tolist()))

    def chosen(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(0x110000, bool)
        out[points[mask]] = True
        return out

    def marked(pattern: str) -> np.ndarray:
        made = normalizers.Replace(Regex(pattern), "\x00").normalize_str(text)
        return np.frombuffer(made.encode("utf-32-le"), np.uint32) == 0

    found = {}
    for name, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s")):
        mask = marked(pattern)
        mask[0] = False  # the mark itself is a control character, of none of the three
        found[name] = _class(chosen(mask))
    odd = np.fromiter((unicodedata.category(c) == "Cn" for c in text), bool, len(text))
    for kind, plain, shapes in (
        (normalizers.Lowercase(), lambda t: t.replace("Σ", "σ").lower(), ("{}",)),
        (normalizers.NFC(), lambda t: unicodedata.normalize("NFC", t), ("{}", "a{}", "\u0345{}\u0334")),
    ):
        for shape in shapes:
            asked = np.flatnonzero(~odd & (points != 10))
            own = [shape.format(text[i]) for i in asked.tolist()]
            odd[asked] = list(map(str.__ne__, map(plain, own), kind.normalize_str("\n".join(own)).split("\n")))
    found["odd"] = _class(chosen(odd))
    return found


class _Shown(dict):
    """Strings made once for each piece, from its ids as 32-bit numbers."""

    def __init__(self, owner: PairIndexBPE, show: Callable[[list[int]], str]):
        self.owner, self.show = owner, show

    def __missing__(self, raw: bytes) -> str:
        shown = self[raw] = self.show(np.frombuffer(raw, "<i4").tolist())
        self.owner.cached += _ENTRY + 2 * len(shown)
        return shown


class PairIndexBPE:
    """A tokenizer file of the word-end kind: lower case, white space dropped, pieces by pattern, byte-level symbols.

    ``classes``: what ``character_classes`` returns; asked here where it isn't given.
    """

    def __init__(self, file: bytes, classes: dict[str, str] | None = None, cache_bytes: int = 96 << 20):
        spec = json.loads(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.token = dict((i, t) for t, i in vocab.items())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.cache_bytes, self.cached = cache_bytes, 0
        symbols = _byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + self.end] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([(a << 32) | b for a, b, _ in self.merge], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        classes = classes or character_classes()
        self.pieces, self.odd = [], []  # for texts below U+10000, and for all
        for cut in (_basic, str):
            letter, number, space, odd = (cut(classes[k]) for k in ("letter", "number", "space", "odd"))
            made = pattern.replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{number}]")
            self.pieces.append(re.compile(made.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")))
            self.odd.append(re.compile(f"[{odd}]"))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.file, self.normalizer = file, None
        spaces = "\t-\r "
        plain = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace("[[a-z]+", "[a-z]+")
        self.plain_pieces = re.compile(plain.replace(r"[^\s", f"[^{spaces}").replace("[[", "[").replace("]]", "]"))
        self.raw_of: dict[str | int, bytes] = {}  # by piece, or by a special token's id: its ids as 32-bit numbers
        self.ids_of = _Shown(self, lambda ids: " ".join(map(str, ids)))  # by those numbers
        self.tokens_of = _Shown(self, self.decode)

    # -- pieces ---------------------------------------------------------------------------------------------------
    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain_pieces.findall(text.lower())
        if self.odd[self.beyond.search(text) is not None].search(text):
            if self.normalizer is None:
                from tokenizers import Tokenizer

                self.normalizer = Tokenizer.from_buffer(self.file).normalizer
            return self.pieces[True].findall(self.normalizer.normalize_str(text))
        text = unicodedata.normalize("NFC", text)  # which may lead beyond U+FFFF
        high = self.beyond.search(text) is not None
        return self.pieces[high].findall(text.replace("Σ", "σ").lower())  # one character at a time: no final sigma

    def split(self, text: str | None) -> list[str | int]:
        """The pieces of a text in order; a special token's string stands as its id."""
        if not text:
            return []
        if self.split_special is None or not self.split_special.search(text):
            return self._pieces(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self._pieces(part)
        return out

    # -- merging --------------------------------------------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], _NEVER)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, end to end, and each word's number of them. Words are not empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[stop - 1] = self.last[raw[stop - 1]]
        after = np.arange(1, len(raw) + 1, dtype=np.int32)
        after[stop - 1] = -1
        before = np.arange(-1, len(raw) - 1, dtype=np.int32)
        before[stop - size] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._rank(symbol[at], symbol[after[at]])
            found = rank != _NEVER
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            edges = [0, *edge.tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:]):
                r = int(rank[lo])
                if r in where:
                    where[r].append(at[lo:hi])
                else:
                    where[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            left, right, made = self.merge[r]
            lists = where.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[symbol[at] == left]
            at = at[after[at] >= 0]
            gone = after[at]
            live = symbol[gone] == right
            at, gone = at[live], gone[live]
            if left == right and len(at) > 1:  # runs of one symbol merge two by two from the left
                taken, chosen = -1, np.ones(len(at), bool)
                order = np.argsort(at)
                for i in order.tolist():
                    if at[i] == taken:
                        chosen[i] = False
                    else:
                        taken = gone[i]
                at, gone = at[chosen], gone[chosen]
            if not len(at):
                continue
            then = after[gone]
            symbol[at] = made
            symbol[gone] = -1
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            ahead = before[at]
            enter(np.concatenate((ahead[ahead >= 0], at[more])))
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive, stop - size, dtype=np.int64)

    def learn(self, pieces: Iterable[str | int]) -> None:
        """Encode the distinct pieces that the cache does not hold yet, all in one index."""
        if self.cached > self.cache_bytes:
            self.raw_of.clear()
            self.ids_of.clear()
            self.tokens_of.clear()
            self.cached = 0
        new = [p for p in set(pieces) if p not in self.raw_of]
        for i in [p for p in new if p.__class__ is int]:
            self.raw_of[i] = np.int32(i).tobytes()
        new = [p for p in new if p.__class__ is str]
        if new:
            ids, counts = self.merge_all([p.encode() for p in new])
            raw, ends = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
            at = 0
            for p, end in zip(new, ends):
                self.raw_of[p] = raw[at:end]
                self.cached += _ENTRY + 4 * len(p) + end - at
                at = end

    # -- texts ----------------------------------------------------------------------------------------------------
    def _raw(self, texts: list[str | None]) -> list[list[bytes]]:
        split = [self.split(t) for t in texts]
        self.learn(p for own in split for p in own)
        return [list(map(self.raw_of.__getitem__, own)) for own in split]

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str]]:
        """For each text its number of tokens and its decimal ids joined by one space."""
        return [made[:2] for made in self.round_trip(texts)]

    def round_trip(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of tokens, its decimal ids joined by one space and what they decode to."""
        for own in self._raw(texts):
            yield sum(map(len, own)) // 4, " ".join(map(self.ids_of.__getitem__, own)), " ".join(map(self.tokens_of.__getitem__, own))

    def encode_arrays(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        raw = [b"".join(own) for own in self._raw(texts)]
        offsets = np.cumsum([0, *map(len, raw)]) // 4
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4").astype(np.int32)))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings joined by one space, as a tokenizer without a decoder does; special tokens are kept."""
        return " ".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens long and ids array<int> of every whole text.

    The tokenizer file is read on the driver and travels with the task, so executors need no copy of it.
    """
    spec, classes = _file(tokenizer_path), character_classes()

    def make() -> Callable[[list], dict]:
        bpe = PairIndexBPE(spec, classes)

        def run(texts: list) -> dict:
            ids = bpe.encode_arrays(texts)
            return {"n_tokens": ids.value_lengths().cast(pa.int64()), "ids": ids}

        return run

    return map_texts(docs, keep, make, "n_tokens long, ids array<int>", slice_bytes=_SLICE)


def decode(encoded: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with decoded, the text of column ids (null: null)."""
    ship_package(encoded.sparkSession)
    spec, classes = _file(tokenizer_path), character_classes()
    schema = encoded.select(*keep).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBPE(spec, classes)
        for batch in batches:
            texts = [bpe.decode(own) if own is not None else None for own in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def encode_digest(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens and SHA-256 digests of the joined ids and of the text decoded from the ids."""
    spec, classes = _file(tokenizer_path), character_classes()

    def make() -> Callable[[list], dict]:
        bpe = PairIndexBPE(spec, classes)

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        def run(texts: list) -> dict:
            made = [(n, sha(ids), sha(decoded)) for n, ids, decoded in bpe.round_trip(texts)]
            return {name: [row[k] for row in made] for k, name in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return run

    return map_texts(docs, keep, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", slice_bytes=_SLICE)


def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    from ._common import read

    return encode_digest(read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), default_tokenizer())

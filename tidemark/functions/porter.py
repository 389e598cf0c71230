"""The Porter stem (M. F. Porter, An algorithm for suffix stripping, 1980, with the author's later rules for -bli and -logi).

Terms repeat, so a worker stems each distinct one once: the column form takes arrays of index terms through Arrow.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of steps 2, 3 and 4 and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """A letter's kind each: v for a vowel, c for anything else; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plurals(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or "v" not in _shape(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
        return word if word[-1] in "lsz" else word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _swap(word: str, rules: dict[str, str]) -> str:
    end = _longest(word, rules)
    if end is not None and _measure(word[: -len(end)]) > 0:
        return word[: -len(end)] + rules[end]
    return word


def _drop(word: str) -> str:
    end = _longest(word, STEP_4)
    if end is None:
        return word
    left = word[: -len(end)]
    return left if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))) else word


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of under 3 or over 64 bytes stay."""
    raw = word.encode()
    if not 3 <= len(raw) <= 64:
        return word
    w = raw.decode("latin-1")  # the rules count bytes
    w = _past(_plurals(w))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _drop(_swap(_swap(w, STEP_2), STEP_3))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode()


@functools.cache
def _udf():
    @F.arrow_udf("array<string>")
    def stems(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()  # a batch's tokens stay in Arrow, only its distinct words are strings here
        own = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        sizes = pc.coalesce(pc.list_value_length(tokens), pa.scalar(0, pa.int32())).to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), own, mask=tokens.is_null())

    return stems


def stemmed(tokens: Column) -> Column:
    return _udf()(tokens)

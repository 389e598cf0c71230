"""Models and stages against plain Python, tables of the library's characters, ledgers, hot groups and odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, fm_index, language_id, line_dedup, mixing, quality_model, quality_rules, secret_scan, substring_dedup

from .test_pair_operators import plain_lines, plain_repeats
from .test_text_operators import WORD, letter_grams, plain_stats

M = (1 << 64) - 1


@pytest.fixture(scope="module")
def texts(small):
    import pyarrow.parquet as pq

    return pq.read_table(f"{small}/documents.parquet").to_pandas().set_index("doc_id").sort_index()


# -- language -----------------------------------------------------------------------------------------------------
def gram_code(gram: str) -> int:
    numbers, code = language_id._letter_numbers(), 0
    for c in gram:
        code = code << language_id._BITS | (1 if c == " " else int(numbers[ord(c)]))
    return code


def plain_order(counts: Counter, top: int) -> list[int]:
    return [c for _, c in sorted((-n, gram_code(g)) for g, n in counts.items())[:top]]


def test_language_prediction_against_plain_distances(spark, texts):
    own, top = texts.head(120), 60
    docs = spark.createDataFrame([(int(i), r.text, r.lang) for i, r in own.iterrows()], "doc_id long, text string, lang string")
    totals: dict[str, Counter] = {}
    for r in own.itertuples():
        totals.setdefault(r.lang, Counter()).update(letter_grams(r.text))
    want = {lang: plain_order(counts, top) for lang, counts in totals.items()}
    profiles = language_id.fit(docs, top)
    assert {k: v.tolist() for k, v in profiles.items()} == want
    rank = {lang: {c: i for i, c in enumerate(codes)} for lang, codes in want.items()}
    for r in language_id.predict(docs, profiles, top).collect():
        codes = plain_order(letter_grams(own.text[r.doc_id]), top)
        far = {lang: sum(abs(rank[lang][c] - i) if c in rank[lang] else top for i, c in enumerate(codes)) for lang in sorted(rank)}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert r.lang_pred == best and abs(r.score - max(0, 1 - far[best] / (top * len(codes)))) < 1e-9


def test_a_long_text_has_the_same_grams_in_pieces(monkeypatch):
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("abé ,.") for _ in range(rng.randint(1, 200)))
        whole = Counter({gram_code(g): n for g, n in letter_grams(text).items()})
        for piece in (1, 2, 7, 1000):
            monkeypatch.setattr(language_id, "_PIECE", piece)
            codes, counts = language_id._one_long(text)
            assert dict(zip(codes.tolist(), counts.tolist())) == dict(whole)


def test_a_dirty_language_column_stays_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i % 50 if i < 400 else i}") for i in range(500)], "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, most_langs=50)) == 50


# -- quality rules ------------------------------------------------------------------------------------------------
def test_quality_verdict_both_ways(spark, texts):
    bands, squeeze = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)
    rng = random.Random(2)
    extra = {-1: "ab cd " * 3000, -2: " ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(10**9)) for _ in range(900)), -3: texts.text.iloc[0][:3000] + " " + rng.randbytes(4000).hex()}
    cases = {**texts.text.to_dict(), **extra}
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    verdicts = Counter()
    for r in quality_rules.score(docs).collect():
        raw = cases[r.doc_id].encode()
        share = lambda part: len(squeeze.compress(part)) / len(part)
        odd, starts = 0, list(range(0, len(raw), 4096)) if len(raw) >= 4096 else []
        for at in starts:
            part = raw[at : at + 4096]
            part = raw[-4096:] if len(part) < 2048 else part
            odd += not bands.chunk[0] <= share(part) <= bands.chunk[1]
        odd_share = odd / len(starts) if starts else 0.0
        low, high = next((lo, hi) for below, lo, hi in bands.whole if len(raw) < below)
        kept = not plain_stats(cases[r.doc_id])[5] and low <= share(raw) <= high and odd_share <= bands.odd_chunks
        assert (r.kept, abs(r.odd_chunk_share - odd_share) < 1e-12) == (kept, True)
        verdicts[kept] += 1
    assert verdicts[True] > 20 and verdicts[False] > 3


# -- classifier ---------------------------------------------------------------------------------------------------
def plain_features(text: str) -> list[list[int]]:
    odd = 0x9E3779B97F4A7C15

    def mix(x: int) -> int:
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & M
        return x ^ x >> 29

    words = [w.encode() for w in WORD.findall(text)]
    if not words:
        return [[] for _ in range(5)]
    hashes = [mix((sum(b * pow(odd, i + 1, 1 << 64) for i, b in enumerate(w)) + len(w) * odd) & M) for w in words]
    line = b" " + b" ".join(words) + b" "
    out = [hashes]
    for n in (3, 4):
        kind = []
        for i in range(len(line) - n + 1):
            if b" " not in line[i + 1 : i + n - 1]:
                rolled = 0
                for b in line[i : i + n]:
                    rolled = (rolled * 0x100000001B3 + b) & M
                kind.append(mix((rolled * odd + n) & M))
        out.append(kind)
    return out + [[mix(((a ^ b) + gap) & M) for a, b in zip(hashes, hashes[gap:])] for gap in (1, 2)]


@pytest.mark.parametrize("piece", [5, 40, 1 << 21])
def test_features_and_scores_against_plain_python(spark, monkeypatch, piece):
    monkeypatch.setattr(quality_model, "_PIECE", piece)
    rng, shape = random.Random(piece), quality_model.Shape(bits=10)
    logit, bias = np.random.default_rng(1).normal(size=1 << 10), 0.25
    cases = ["", " \t\n", "a", "one  two\n\nthree é", *(" ".join(rng.choice(["ab", "çd", "e", "fghijkl"]) for _ in range(rng.randint(1, 60))) for _ in range(20))]
    for text in cases:
        got = [sorted(x for part in quality_model.features(text) for x in part[k].tolist()) for k in range(5)]
        assert got == [sorted(kind) for kind in plain_features(text)]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    if piece == 1 << 21:
        for r in quality_model.predict(docs, (logit, bias), shape).collect():
            means = [np.mean([np.float32(logit[h >> 54]) for h in kind]) for kind in plain_features(cases[r.doc_id]) if kind]
            assert abs(r.score - 1 / (1 + np.exp(-(bias + (np.mean(means) if means else 0.0))))) < 1e-6


def test_training_against_dense_steps():
    rng, shape = np.random.default_rng(3), quality_model.Shape(bits=5, dim=3, epochs=3)
    rows = [(int(k % 2), np.sort(rng.choice(32, 6, replace=False)), rng.dirichlet(np.ones(6)).astype(np.float32)) for k in range(30)]
    logit, bias = quality_model.train(rows, shape)
    draw = np.random.default_rng(shape.seed)
    vectors, layer = draw.normal(0, 0.1, (32, 3)), draw.normal(0, 0.5, (2, 3))
    b, seen, step = np.zeros(2), np.full(32, 1e-6), 0
    for _ in range(shape.epochs):
        for k in draw.permutation(len(rows)).tolist():
            label, own, weight = rows[k]
            dense = np.zeros(32)
            dense[own] = weight
            rate = shape.rate * (1 - step / (shape.epochs * len(rows)))
            step += 1
            mean = dense @ vectors
            p = np.exp(layer @ mean + b)
            p /= p.sum()
            p[label] -= 1
            down = layer.T @ p
            layer, b = layer - 0.1 * rate * np.outer(p, mean), b - 0.1 * rate * p
            seen += dense**2 * (down @ down)
            vectors = vectors - (rate * dense / np.sqrt(seen))[:, None] * down[None, :]
    assert np.allclose(logit, vectors @ (layer[1] - layer[0]), atol=1e-3) and abs(bias - (b[1] - b[0])) < 1e-4


def test_the_sample_is_bounded_by_features(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    logit, _ = quality_model.fit(docs, labels, quality_model.Shape(bits=12, sample_features=2000))
    assert np.count_nonzero(logit) and len(logit) == 1 << 12


# -- BPE ----------------------------------------------------------------------------------------------------------
def test_every_code_point_as_the_library_has_it():
    path = bpe.default_tokenizer()
    library, own = Tokenizer.from_file(path), bpe.PairIndexBPE(open(path, "rb").read())
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 1 << 16):
        part = [points[i : i + 64] for i in range(at, min(at + (1 << 16), len(points)), 64)]
        shown = [" ".join(f"a{chr(p)}b1{chr(p)}'s x" for p in own_points) for own_points in part]
        want = [" ".join(map(str, e.ids)) for e in library.encode_batch(shown, add_special_tokens=False)]
        assert [ids for _, ids in own.encode_batch(shown)] == want


def test_the_cache_is_bounded():
    own = bpe.PairIndexBPE(open(bpe.default_tokenizer(), "rb").read(), cache_bytes=50_000)
    for k in range(20):
        list(own.round_trip([" ".join(f"w{k}x{i}" for i in range(300))]))
        assert own.cached < 400_000 and len(own.raw_of) < 1500


# -- mixing, ledger -----------------------------------------------------------------------------------------------
def test_mixed_rows_keep_clashing_columns(spark):
    rows = [(i, "w " * 20, "s", 7 * i, i, -i, "k") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long, epoch int, block int, shuffle_key string")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)


def test_rows_without_ids_spread_over_blocks(spark):
    docs = spark.createDataFrame([(None, f"text number {i} of many", "s") for i in range(400)], "doc_id long, text string, source string")
    assert len({r.block for r in mixing.mix(docs, mixing.Target(block_docs=50)).collect()}) == 8


def test_a_ledger_scans_each_blob_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "password = hunter22"), (2, None), (3, "password = hunter22")], "doc_id long, text string")
    assert secret_scan.update(first, path).count() == 2
    assert secret_scan.scan_unseen(first, secret_scan.stored(spark, path)).count() == 0
    more = first.unionByName(spark.createDataFrame([(4, "token: abcdef9")], first.schema))
    assert secret_scan.update(more, path).count() == 3
    other = secret_scan.RULES[:1]
    assert secret_scan.scan_unseen(more, secret_scan.stored(spark, path), other).count() == 3
    found = {r.doc_id: len(r.spans) for r in secret_scan.join_back(more, secret_scan.stored(spark, path)).collect()}
    assert found == {1: 1, 2: 0, 3: 1, 4: 1}
    assert secret_scan.stored(spark, str(tmp_path / "none")) is None


# -- lines --------------------------------------------------------------------------------------------------------
def test_huge_lines_hot_lists_and_common_lines(spark):
    rng = random.Random(8)
    huge = [f"v{i}" for i in range(66_000)]
    docs = {0: " ".join(huge), 1: " ".join(huge[3000:]), 2: " ".join(huge[:40_000])}
    near = [f"n{i}" for i in range(30)]
    for d in range(3, 260):
        words = list(near)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(30)] = f"x{rng.randrange(400)}"
        docs[d] = "\n".join(["the common line of all", " ".join(words), "Page", f"only here {d}"])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    rule = line_dedup.Rule(earliest=8, strong=4, floor=2, heavy=50)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, rule).collect()} == plain_lines(docs)


# -- substrings ---------------------------------------------------------------------------------------------------
def test_a_run_has_one_hash_wherever_it_stands():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    found = []
    for before, after in ((0, 70), (13, 40), (200, 5)):
        text = np.concatenate((rng.integers(0, 1 << 62, before).astype(np.uint64), passage, rng.integers(0, 1 << 62, after).astype(np.uint64)))
        anchor, content, start, size = substring_dedup.runs(text, 50, 10)
        inside = (start > before) & (start + size + 49 < before + 120)
        found.append(set(zip(anchor[inside].tolist(), content[inside].tolist())))
    assert found[0] and found[0] == found[1] == found[2]


def test_range_minima():
    rng = np.random.default_rng(6)
    for n in (1, 2, 15, 16, 63, 64, 65, 129, 700):
        values = rng.integers(0, 1000, n).astype(np.int32)
        low = rng.integers(0, n, 400)
        high = np.minimum(n, low + 1 + rng.integers(0, n, 400))
        assert fm_index.Minima(values).of(low, high).tolist() == [int(values[a:z].min()) for a, z in zip(low, high)]


def test_hot_anchors_and_a_long_text(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = [(d, " ".join([f"u{d}x{i}" for i in range(rng.randint(0, 30))] + passage[rng.randint(0, 5) :] + [f"t{d}"])) for d in range(150)]
    long_ = [f"l{rng.randrange(3000)}" for _ in range(30_000)]
    rows += [(500, " ".join(long_)), (501, " ".join(long_[10_000:10_300])), (499, " ".join(long_[29_000:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == plain_repeats(rows, 50)


# -- stages -------------------------------------------------------------------------------------------------------
def test_stages_take_odd_rows_and_clashing_columns(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    prose = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(120)) for _ in range(6)]
    rows = [(1, prose[0]), (2, prose[0]), (3, prose[1]), (3, prose[1]), (None, prose[2]), (4, None), (5, ""), (6, " \n\t"), (7, " ".join(prose) + " " + " ".join(reversed(" ".join(prose * 40).split()))), (8, prose[3]), (8, prose[4])]
    clash = ["tokens", "epoch", "block", "shuffle_key", "key", "line", "codes", "gone", "fp", "n_lines_removed", "kept", "ids"]
    full = [(d, t, "en", f"s{i % 2}", *[f"{c}{i}" for c in clash]) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
    carried = {r[4]: r for r in full}
    stages = dict(pipeline.STAGES)
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        for r in out.collect():
            before = carried[r.tokens]
            assert tuple(r[c] for c in clash) == before[4:] and r.doc_id == before[0] and (name == "line_dedup" or r.text == before[1])
    kept = Counter(r.doc_id for r in stages["quality_rules"](spark, docs, small).collect())
    assert kept[1] == kept[2] == 1 and kept[3] == 2 and not {4, 5, 6} & set(kept)
    near = Counter(r.doc_id for r in stages["simhash_near_dedup"](spark, docs, small).collect())
    assert near == Counter({1: 1, 3: 1, None: 1, 4: 1, 7: 1, 8: 2})
    encoded = {r.doc_id: r.n_tokens for r in stages["bpe"](spark, docs, small).collect()}
    assert encoded[4] == encoded[5] == encoded[6] == 0 and encoded[1] > 100

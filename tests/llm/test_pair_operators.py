"""Joins, searches and the pipeline against brute force, with ties, repeats, hot groups, nulls and empty tables."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fm_index, line_dedup, multiprobe, simhash, substring_dedup
from tidemark.llm.components import components
from tidemark.llm.registry import queries


@pytest.fixture(scope="module")
def texts(small):
    import pyarrow.parquet as pq

    return pq.read_table(f"{small}/documents.parquet").to_pandas().set_index("doc_id").sort_index().text


def classes(pairs) -> set:
    groups = defaultdict(set)
    for node, root in pairs:
        groups[root].add(node)
    return {frozenset(g) for g in groups.values()}


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- components and fingerprints ----------------------------------------------------------------------------------
def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 3), (3, 7)]
    got = [(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert classes(got) == classes(union_find(nodes, [e for e in edges if e[0] != e[1]]).items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("distance", "bucket"), [(2, 16), (2, 512), (3, 64)])
def test_links_join_exactly_what_is_close(spark, distance, bucket):
    rng = random.Random(distance * bucket)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    hot = rng.getrandbits(64)
    for _ in range(400):  # one bucket in every choice of blocks
        x = hot
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(13)
        prints.add(x)
    values = np.array(sorted(prints), np.uint64)
    near = [(i, i + 1 + j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= distance).tolist()]
    signed = values.view(np.int64).tolist()
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, bucket)).collect()}
    assert classes((v, found.get(v, v)) for v in signed) == classes((signed[n], signed[r]) for n, r in union_find(range(len(values)), near).items())


def test_simhash_query(spark, small, texts):
    rows = {r.doc_id: r for r in queries()["op3_simhash"](spark, small).collect()}
    prints = {d: int(r.fingerprint, 16) for d, r in rows.items()}
    assert prints == {d: simhash.fingerprint(t, 3) for d, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {d: r.component_id for d, r in rows.items()} == union_find(prints, near)


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(5, None, 1), (2, "", 1), (9, "a b c d", 1), (9, "a b c d", 1), (7, "A  b\tc d", 1), (None, "z", 1)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (2, 2), (5, 2), (7, 7), (9, 7), (9, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 7]
    twice = spark.createDataFrame([(1, "a b c d e", 0), (1, "a b c d e", 0)], docs.schema)
    assert simhash.keep_one(twice).count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingle_sets(docs: dict[int, str]) -> dict[int, frozenset]:
    words = {d: t.encode().lower().split() for d, t in docs.items()}
    return {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in words.items()}


@pytest.mark.parametrize("n_words", [3, 12, 150])
def test_keep_one_against_brute_force_jaccard(spark, n_words):
    rng = random.Random(n_words)
    docs, loose = {}, 0
    for d in range(160):
        words = [f"W{rng.randrange(4000)}" for _ in range(n_words)]
        if d > 10 and rng.random() < 0.7:
            words = docs[rng.randrange(d)].split()
            for _ in range(rng.randint(0, max(1, n_words // 40))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
        docs[d] = rng.choice([" ", "\n", "\t "]).join(words)
    sets = shingle_sets(docs)
    gone = set()
    for b in docs:
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                gone.add(b)
                loose += (simhash.fingerprint(docs[a], 5) ^ simhash.fingerprint(docs[b], 5)).bit_count() > 3
    assert gone and (loose or n_words < 150)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(frame).collect()} == set(docs) - gone


def test_fingerprints_settle_their_classes_without_the_join(spark, monkeypatch):
    rng = random.Random(8)
    docs = {d: [f"w{rng.randrange(4000)}" for _ in range(400)] for d in range(12)}
    for d in range(12, 60):
        docs[d] = [*docs[rng.randrange(d)]]
        docs[d][rng.choice((0, rng.randrange(400)))] = f"x{d}"
    docs = {d: " ".join(w) for d, w in docs.items()}
    docs |= {60: docs[3].upper(), 61: docs[4].replace(" ", "  "), 62: "", 63: None, 64: docs[5]}
    sets, ids = shingle_sets({d: t for d, t in docs.items() if t}), {}
    for d in sets:
        ids.setdefault(xxhash.xxh3_128_digest(docs[d].encode().lower())[:8], d)
    prints = {d: simhash.fingerprint(docs[d], 5) for d in ids.values()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    first = union_find(prints, near)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    number = {int.from_bytes(i, sys.byteorder, signed=True): d for i, d in ids.items()}
    pairs = [(number[r.line], number[r.earlier]) for r in simhash.alike(frame, line_dedup.Rule(shingle=5)).collect()]
    assert sorted(pairs) == sorted((d, f) for d, f in first.items() if d != f) and len(pairs) > 20
    nothing = spark.createDataFrame([], "line long, earlier long, apart int, list long")
    monkeypatch.setattr(line_dedup, "_candidates", lambda packed, rule: nothing)
    gone = {d for d, f in pairs if 5 * len(sets[d] & sets[f]) >= 4 * len(sets[d] | sets[f])} | {60, 63, 64}
    assert len(gone) > 20 and {r.doc_id for r in simhash.keep_one(frame).collect()} == set(docs) - gone


# -- lines --------------------------------------------------------------------------------------------------------
def plain_lines(docs: dict[int, str], least: int = 1) -> dict[int, str]:
    """Words of lines meet through an inverted list; a line goes if any earlier one has Jaccard 0.8 or more."""
    seen, lists, out = [], defaultdict(list), {}
    for doc in sorted(docs):
        kept = []
        for line in docs[doc].split("\n"):
            words = line.encode().split()
            own = frozenset(words)
            shared = defaultdict(int)
            for w in own:
                for other in lists[w]:
                    shared[other] += 1
            if len(words) < least or not any(5 * n >= 4 * (len(own) + len(seen[o]) - n) for o, n in shared.items()):
                kept.append(line)
            if len(words) >= least:
                for w in own:
                    lists[w].append(len(seen))
                seen.append(own)
        out[doc] = "\n".join(kept)
    return out


def line_corpus(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    docs = {}
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "\t"]).join(words))
        docs[d] = "\n".join(lines)
    return docs


@pytest.mark.parametrize("earliest", [1, 16])
def test_line_dedup(spark, earliest):
    docs = line_corpus(earliest)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    rule = line_dedup.Rule(earliest=earliest, strong=max(1, earliest // 8), floor=2, heavy=20, counted=30)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, rule).collect()} == plain_lines(docs)


def test_line_sets():
    docs = line_corpus(5)
    lines = line_dedup.Lines([t.encode() for t in docs.values()], line_dedup.Rule())
    none = np.empty(0, np.uint64)
    codes, size = lines.sets(lines.eligible, none, none)
    want = [line.split() for t in docs.values() for line in t.split("\n") if line.split()]
    assert size.tolist() == [len(set(w)) for w in want]
    ends = np.cumsum(size)
    names: dict = {}
    for words, n, z in zip(want, size.tolist(), ends.tolist()):
        own = codes[z - n : z].tolist()
        assert own == sorted(set(own))
        names.setdefault(frozenset(words), frozenset(own))
        assert names[frozenset(words)] == frozenset(own)


def test_line_query(spark, small, texts):
    want = plain_lines(texts.to_dict())
    got = {r.doc_id: r.kept_sha256 for r in queries()["op7_line_dedup"](spark, small).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_line_edges(spark):
    line = "one two three four five six"
    rows = [(4, line, 1), (2, None, 1), (3, "", 1), (1, f"{line}\nshort\nshort", 1), (5, f"{line} \n{line}", 1), (None, line, 1), (1, f"{line}\nshort\nshort", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines_removed int")
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(docs.drop("n_lines_removed")).fillna("NULL").collect())
    assert got == [(-1, line), (1, f"{line}\nshort"), (1, f"{line}\nshort"), (2, "NULL"), (3, ""), (4, ""), (5, "")]
    kept = line_dedup.keep_first_lines(docs.drop("n_lines_removed"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 2, 3]
    assert line_dedup.dedup_lines(docs.select("doc_id", "text").limit(0)).count() == 0


# -- substrings ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("few", [0, 3, 512])
def test_fm_index_finds_all_windows(monkeypatch, few):
    monkeypatch.setattr(fm_index, "_FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(40):
        window = int(rng.integers(2, 8))
        pool = [rng.integers(0, rng.integers(2, 30), 40) for _ in range(4)]
        owners = np.sort(rng.integers(0, 20, int(rng.integers(2, 40))))
        parts = [np.concatenate([pool[rng.integers(0, 4)][a : a + int(rng.integers(1, 25))] for a in rng.integers(0, 10, 3)] + [rng.integers(0, 50, int(rng.integers(0, 6)))]) for _ in owners]
        parts = [p.astype(np.uint64) for p in parts]
        got = fm_index.matched_windows(np.concatenate(parts), np.array(list(map(len, parts))), owners, window)
        for k, own in enumerate(parts):
            earlier = {tuple(p[i : i + window]) for p, o in zip(parts, owners) if o < owners[k] for i in range(len(p) - window + 1)}
            assert {x for a, b in got[k] for x in range(a, b)} == {i for i in range(len(own) - window + 1) if tuple(own[i : i + window]) in earlier}


def plain_repeats(rows: list[tuple], window: int) -> list[tuple]:
    first: dict = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((d if d is not None else -1, len(words), len(gone), kept.decode()))
    return sorted(out)


def test_substring_dedup(spark):
    rng = random.Random(9)
    passages = [[rng.choice("abcdefghij") for _ in range(rng.randint(10, 90))] for _ in range(6)]
    rows = []
    for d in range(80):
        words = []
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "z"
            words += [f"u{d}-{i}" for i in range(rng.randint(0, 12))] + p
        rows.append((d, " ".join(words)))
    rows += [(d, "te " * 300) for d in (90, 91)] + [(None, " ".join(passages[0])), (95, None), (96, ""), (3, rows[3][1]), (3, " ".join(passages[1] * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, window=12, gram=4).collect())
    assert got == plain_repeats(rows, 12)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_query(spark, small, texts):
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain_repeats(list(texts.items()), 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries()["op8_substring_dedup"](spark, small).collect()}
    assert got == want


# -- neighbours ---------------------------------------------------------------------------------------------------
def plain_neighbours(ids, matrix, query, k=10):
    far = np.sqrt(((matrix - matrix[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[query]][:k]
    return [int(ids[i]) for i in order], far


def test_neighbour_query(spark, small):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{small}/embeddings.parquet").to_pandas().sort_values("vec_id")
    ids, matrix = table.vec_id.to_numpy(), np.stack([np.asarray(v, float) for v in table.embedding])
    got = defaultdict(list)
    for r in queries()["op10_multiprobe"](spark, small).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    recall = []
    for at in np.flatnonzero(ids % 100 == 0):
        want, far = plain_neighbours(ids, matrix, at)
        own = got[int(ids[at])]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r.score - far[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in own)
        recall.append(len({r.vec_id for r in own} & set(want)) / 10)
    assert np.mean(recall) >= 0.9


def test_neighbour_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 30)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 400)]
    bad = [(900, None), (901, [0.0] * 4), (902, [float("nan")] + [1.0] * 3), (903, [None] + [1.0] * 3), (904, [1.0] * 3), (905, [float("inf")] + [1.0] * 3), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<double>")
    got = multiprobe.search(frame, F.col("vec_id").isin(100, 5, 900, 904)).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {5, 100}
    assert [r.vec_id for r in got if r.query_id == 100] == list(range(101, 111)) and all(r.score == 0 for r in got if r.query_id == 100)
    few = spark.createDataFrame(rows[:4], frame.schema)
    assert sorted((r.query_id, r["rank"]) for r in multiprobe.search(few, F.col("vec_id") <= 2).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert multiprobe.search(frame.limit(0), F.col("vec_id") > 0).count() == 0


# -- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline_against_brute_force(spark, small, texts):
    import zstandard

    from tidemark.llm import bpe, mixing, quality_rules

    pipeline = pytest.importorskip("corpus_pipeline")
    bands, squeeze = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)
    kept = {d: t for d, t in texts.items() if quality_rules.judge(t, bands, squeeze)[6]}
    left = {d: t for d, t in plain_lines(kept).items() if t.split() or not kept[d].split()}
    sets = shingle_sets(left)
    stay = {b: t for b, t in left.items() if not any(a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in left)}
    import duckdb
    import pandas as pd
    import pyarrow.parquet as pq

    sources = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "source"]).to_pandas().set_index("doc_id").source
    documents = pd.DataFrame({"doc_id": list(stay), "text": list(stay.values()), "source": [sources[d] for d in stay]})  # noqa: F841
    mixed = duckdb.sql(mixing.SQL).df()
    coder = bpe.PairIndexBPE(open(bpe.default_tokenizer(), "rb").read())
    want = sorted((int(d), tuple(map(int, coder.encode_batch([stay[d]])[0][1].split()))) for d in mixed.doc_id)
    assert sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, small).collect()) == want


def test_pipeline_stages_on_an_empty_table(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns

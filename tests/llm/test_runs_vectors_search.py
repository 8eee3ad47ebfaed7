"""Word runs, near vectors and lexical search: brute force, hot groups, nulls, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import lexical, queries, vectordup, wordruns

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "runs words a p h node comp key n bucket item rank score term rows size".split()


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def made_words(rng):
    letters = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 8, 30, 100]))]
    for _ in range(rng.randint(0, 3)):
        period = [rng.randrange(max(letters, 2)) for _ in range(rng.randint(1, 8))]
        at = rng.randint(0, len(words))
        words[at:at] = (period * rng.randint(3, 7))[: len(period) * 7 - rng.randrange(len(period))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        docs = [made_words(rng) for _ in range(rng.randint(1, 5))]
        docs += [docs[0]] * rng.randint(0, 2)  # copies share their nonterminals
        ids = np.array([w for d in docs for w in d], np.int64)
        assert wordruns.grammar_runs(ids, [len(d) for d in docs]) == [plain_runs(d) for d in docs]


@pytest.mark.parametrize("words, runs", [
    (np.zeros(300_000, np.int64), [(0, 300_000, 1)]),
    (np.tile(np.arange(1000), 300), [(0, 300_000, 1000)]),
    (np.concatenate([np.arange(5), np.tile([7, 8], 3), [7], np.arange(5)]), []),  # seven words of period two are too few
    (np.concatenate([np.arange(5), np.tile([7, 8], 4), np.arange(5)]), [(5, 13, 2)]),
    (np.array([1] * 5 + [2] * 6), [(5, 11, 1)]),
])
def test_runs_of_long_and_short_documents(words, runs):
    assert wordruns.grammar_runs(words, [len(words)]) == [runs]


def test_a_grammar_leaves_no_pair_twice():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 3000)
    grammar = wordruns.Grammar(ids, np.zeros(3000, np.int64))
    pairs, last = Counter(), None
    for i, pair in enumerate(zip(grammar.symbols[:-1].tolist(), grammar.symbols[1:].tolist(), strict=True)):
        if last != (i - 1, pair):
            pairs[pair] += 1
            last = (i, pair)
    assert max(pairs.values()) == 1
    text = {i: [i] for i in range(4)}
    for x, (a, b) in enumerate(zip(grammar.left.tolist(), grammar.right.tolist(), strict=True)):
        text[grammar.first + x] = text[a] + text[b]
        assert text[grammar.first + x] == ids[grammar.at[x] : grammar.at[x] + grammar.length[x]].tolist()
    assert [w for s in grammar.symbols.tolist() for w in text[s]] == ids.tolist()


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query_equals_a_plain_one(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{w}" for w in made_words(rng)) + " \t é" * (i % 3), "en", "a", 1) for i in range(150)]
    rows += [(None, "a a a a a a b", "en", "a", 1), (1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (1002, " \n\x0b ", "en", "a", 1), (1003, "x " * 50_000, None, None, 1), rows[3], rows[3]]
    rows.append((1004, "a b " * 3 + "a b", "en", "a", 1))
    clashing(spark.createDataFrame(rows, DOCS).repartition(3)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_repair_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        # brute force has all periods of a run of one word, the plainest first
        runs = [(s, e - s, q) for s, e, q in (plain_runs(words) if len(words) < 5000 else [(0, len(words), 1)])]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
        want.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *digests))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_runs_of_no_rows_and_small_windows(spark):
    assert wordruns.word_runs(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(i, "a b " * (4 + i % 3) + f"c{i}", "en", "a", 1) for i in range(30)], DOCS)
    rows = wordruns.word_runs(docs, window=20).collect()
    assert {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in rows} == {(i, ((0, 2 * (4 + i % 3), 2),), f"a b c{i}") for i in range(30)}


def plain_links(rows, least=0.95):
    """vec_id to (number of links, component) over all pairs."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    links = {i: 0 for i, _ in ok}
    top = {i: i for i in links}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, (i, u) in enumerate(ok):
        for j, v in ok[x + 1 :]:
            if len(u) == len(v) and (u / np.abs(u).max()) @ (v / np.abs(v).max()) / (np.linalg.norm(u / np.abs(u).max()) * np.linalg.norm(v / np.abs(v).max())) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (links[i], find(i)) for i in links}


def made_vectors(rng, groups, noise, single, d=24):
    out = []
    for size in groups:
        base = rng.standard_normal(d)
        out += [base + noise * rng.standard_normal(d) * rng.random() for _ in range(size)]
    out += list(rng.standard_normal((single, d)))
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("tile, crowd", [(1024, 128), (16, 8)])
@pytest.mark.parametrize("noise", [0.15, 0.32])
def test_links_equal_brute_force(spark, monkeypatch, tile, crowd, noise):
    # small tiles send the groups through hubs, doubts, cores and rectangles; wide noise leaves pairs of a group unlinked
    monkeypatch.setattr(vectordup, "TILE", tile)
    monkeypatch.setattr(vectordup, "CROWD", crowd)
    rows = made_vectors(np.random.default_rng(4), [150, 40, 3, 2], noise, 200)
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [2 * x for x in rows[0][1]]), (903, [x * 1e200 for x in rows[1][1]])]
    got = vectordup.near_vectors(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), miss=1e-6).collect()
    want = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_that_take_no_part(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.95, math.sqrt(1 - 0.95**2)]), (11, [0.94, math.sqrt(1 - 0.94**2)]),
    ]
    got = sorted((tuple(r) for r in vectordup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    # 10 links with 1, 2 and 11; 11 only with 10
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *alone, (10, 3, 1, False), (11, 1, 1, False)]
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectordup.near_vectors(empty).count() == 0


def test_tables_grow_slowly():
    assert vectordup.tables_of(0) == (1, 4)
    sizes = [vectordup.tables_of(10**e)[1] for e in range(3, 10)]
    assert sizes == sorted(sizes) and sizes[-1] < 110


def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc_id, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in term.findall((text or "").translate(lower)) if t in bag)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if missing else doc_id, -score) for rank, (score, missing, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 40])
def test_search_equals_brute_force(spark, block_bytes):
    rng = random.Random(2)
    pool = ["Alpha", "beta", "gamma7", "Été", "straße", "naïve", "x", "under_score", "o'neil", "tab\tbed", "İstanbul", "日本", "zero\x00byte", "the", "THE", "a-b"]
    docs = [(i, " ".join(rng.choices(pool, weights=range(1, len(pool) + 1), k=rng.choice([1, 3, 20, 200])))) for i in range(300)]
    docs += [(None, "alpha beta"), (700, None), (701, ""), (702, "-- !!"), (703, docs[0][1]), (703, docs[0][1]), (-5, docs[0][1]), (704, "the " * 60_000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 6])))) for i in range(12)] + [(50, None), (51, "unheard of"), (52, "beta beta BETA"), (53, "")]
    docs_df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    items_df = clashing(spark.createDataFrame([*items, items[0], (None, "alpha")], "item_id long, text string"))
    got = sorted((tuple(r) for r in lexical.search(docs_df, items_df, block_bytes=block_bytes).collect()), key=str)
    assert got == plain_search(docs, items) and len(got) > 100
    assert lexical.search(docs_df.limit(0), items_df).count() == 0 and lexical.search(docs_df, items_df.limit(0)).count() == 0

"""Operators on documents: brute force, planted cases, nulls, ties, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import fingerprints, langid, mixing, neardup, packing, pii, quality, sharding, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = [" ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) for i in range(12)]
NASTY = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (None, "no id here at all, really none", "en", "b", 31), (4, PROSE[0], "en", "a", 1), (5, PROSE[0], "en", "a", 1),
    (5, PROSE[0], "en", "a", 1), (6, PROSE[0].replace("word3 ", "WORD3 "), "en", None, 1), (7, "x" * 200_000, "de", "b", 200_000), (8, "é😀 " * 2000, "fr", "b", 6000), (9, "one", "en", "c", 3),
    (10, "a@b.c_d@e.f call +1 (234) 555-6789 4111 1111 1111 1111 from 10.0.0.1 or 256.1.1.1", "en", "c", 80), (11, "<|endoftext|> is text", "en", "c", 21),
]


@pytest.fixture(scope="module")
def nasty(spark):
    # an input column that is named like a result or an inner column must do no harm
    return spark.createDataFrame(NASTY, SCHEMA).withColumns({"size": F.lit("clash"), "taken": F.lit(1), "spans": F.lit(0), "node": F.lit(2), "__key": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_targets_and_cuts(spark, nasty, empty):
    assert mixing.mix_sources(empty).count() == 0
    rows = mixing.mix_sources(nasty.withColumns({"row": F.lit(1), "group": F.lit(2), "key": F.lit(3), "bucket": F.lit(4), "inside": F.lit(5), "budget": F.lit(6), "before": F.lit(7)})).collect()
    assert len(rows) == len(NASTY)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for group in by.values():
        assert sum(r.taken for r in group) == int(group[0].target) and sum(r["size"] for r in group) == group[0].source_size
        assert all(r.taken <= 3 * r["size"] for r in group)
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = {(r.doc_id, r["size"]): r.taken for r in mixing.mix_sources(nasty.drop("__key").repartition(3)).collect()}
    assert all(again[r.doc_id, r["size"]] == r.taken for r in rows if r.doc_id != 5)


def test_targets_of_scarce_sources(spark):
    # a: weight 5 but only 10 words, so it stops at 30; b and c share the other 190 by 2 to 1
    totals = spark.createDataFrame([("a", 10), ("b", 90), ("c", 120)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(totals).collect()}
    assert found == pytest.approx({"a": 30.0, "b": 190 * 2 / 3, "c": 190 / 3})


def test_expanded_mix_has_the_budget(spark):
    docs = spark.createDataFrame([(i, PROSE[i], "en", "abc"[i % 3], 1) for i in range(12)], SCHEMA)
    mixed = mixing.mix_sources(docs)
    out = mixing.expand_mix(mixed, docs.columns)
    assert out.columns == docs.columns
    total = sum(len(r.text.split()) for r in out.collect())
    assert total == mixed.agg(F.sum("taken")).first()[0]


def test_shards_are_even_and_gapless(spark, nasty, empty):
    assert sharding.shard_rows(empty).count() == 0
    docs = spark.createDataFrame([(i, "t" * (i % 50), "en", "abbbbc"[i % 6], 1) for i in range(500)], SCHEMA)
    rows = sharding.shard_rows(docs).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
        assert r["size"] == r.doc_id % 50 + 8 and r.text_crc32 == zlib.crc32(b"t" * (r.doc_id % 50))
    assert set(shards) == set(range(24)) and {len(s) for s in shards.values()} <= {20, 21}
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert 12 <= sum(r.source == "b" for r in s) <= 15  # two thirds of every shard
    assert sharding.shard_rows(nasty.drop("__key")).count() == len(NASTY)


def test_order_minhash_is_sensitive_to_order():
    a = PROSE[0]
    other = " ".join(reversed(a.split()))
    f = fingerprints.order_minhash
    assert (f(a) == f(str(a))).all() and not f("").any()
    swapped = a[len(a) // 2 :] + a[: len(a) // 2]
    near = fingerprints.likeness(f(a), f(a.replace("word9 ", "wordy ", 1)))
    assert near > fingerprints.likeness(f(a), f(swapped)) > fingerprints.likeness(f(a), f(other)) - 0.2
    x = np.array([3, 5, 3, 3, 5], np.uint64)
    assert fingerprints.occurrences(x).tolist() == [0, 0, 1, 2, 1]


def test_fingerprints_match_brute_force(spark, nasty, empty):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    got = fingerprints.fingerprint_documents(nasty.repartition(5)).collect()
    assert len(got) == len(NASTY)
    ids = spark.createDataFrame([(i * 3, PROSE[i] * (i + 1)) for i in range(12)], "doc_id long, text string")
    order = sorted(((i * 3, PROSE[i] * (i + 1)) for i in range(12)), reverse=True)
    want = {}
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        want[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_text(fingerprints.order_minhash(text)), fingerprints.as_text(fingerprints.order_minhash(changed)))
    for r in fingerprints.fingerprint_documents(ids).collect():
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id]
    equal = {r.fingerprint for r in got if r.doc_id in (4, 5)}
    assert len(equal) == 1


_M64 = (1 << 64) - 1


def _scramble(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


def _plain_order_minhash(text: str) -> list[int]:
    """Slot by slot over a list of (k-mer, occurrence), in plain integers."""
    if not text:
        return [0] * fingerprints.SLOTS
    k = min(fingerprints.K, len(text))
    seen: dict[str, int] = defaultdict(int)
    found = []
    for i in range(len(text) - k + 1):
        kmer = text[i : i + k]
        code = 0
        for c in kmer:
            code = (code * 0x100000001B3 + ord(c)) & _M64
        code = _scramble(code)
        found.append((code, _scramble(code + seen[kmer] * 0x9E3779B97F4A7C15 & _M64) if len(text) > k else code))
        seen[kmer] += 1
    slots = []
    for odd in fingerprints._ODD.tolist():
        least = sorted(range(len(found)), key=lambda i: found[i][1] * odd & _M64)[: fingerprints.TUPLE]
        value = len(least)
        for i in sorted(least):
            value = _scramble(value * 0x9E3779B97F4A7C15 + found[i][0] & _M64)
        slots.append(value >> 32 | 1)
    return slots


def test_fingerprints_and_likeness_match_a_plain_reimplementation(spark):
    texts = [None, "", "abc", "abcde", "aaaaaaaaaaaa", "abababab", "é😀" * 40, *PROSE[:6], PROSE[0], PROSE[0].upper()]
    ids = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(ids).collect()}
    order = [(i, texts[i] or "") for i in reversed(range(len(texts)))]
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text) // 3
        own, changed, following = (_plain_order_minhash(t) for t in (text, text[: len(text) - n] + after[:n], after))
        as_hex = lambda slots: "".join(f"{x:08x}" for x in slots)
        assert (got[doc].fingerprint, got[doc].edited_fingerprint) == (as_hex(own), as_hex(changed))
        assert (got[doc].near_edited, got[doc].near_next) == (share(own, changed), share(own, following))
    assert got[13].near_next < 0.2 and got[0].near_edited == 1


def _components_by_brute_force(rows):
    sets = {}
    for doc, text in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[doc] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


def test_near_duplicates_match_brute_force(spark, nasty, empty):
    assert neardup.near_duplicates(empty).count() == 0
    rows = []
    for i in range(40):
        base = [f"w{(i // 4) * 1000 + j * j % 500}" for j in range(80)]
        for k in range(i % 4):
            base[5 + 17 * k] = f"new{i}{k}"
        rows.append((i, " ".join(base)))
    rows += [(100, "one two three"), (101, "ONE two\tthree"), (102, "one two four"), (103, None), (104, " ")]
    sets, comp = _components_by_brute_force(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.component_id for d, r in got.items()} == comp
    assert all(r.n_shingles == len(sets[d]) and r.kept == (comp[d] == d) for d, r in got.items())
    odd = neardup.near_duplicates(nasty).collect()
    assert len(odd) == len(NASTY) and all(r.kept and r.component_id is None for r in odd if r.doc_id is None)
    assert {r.component_id for r in odd if r.doc_id in (4, 5, 6)} == {4}


def test_pairs_behind_unlinked_hubs_are_found(spark):
    # one passage in every document: similarities of 0.73 at most fill buckets with documents that link
    # with their own partner only, mostly not the bucket's first hub
    rows = []
    for i in range(60):
        text = [f"w{j}" for j in range(100)]
        text[20], text[40], text[60] = (f"{c}{i // 2}" for c in "abc")
        text[90] = f"d{i}" if i % 2 else text[90]
        rows.append((i * 37 % 60, " ".join(text)))
    _, comp = _components_by_brute_force(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(set(comp.values())) == 30 and {r.doc_id: r.component_id for r in got.collect()} == comp
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = neardup.near_duplicates(docs, rounds=neardup.ROUNDS[:1], exhaustive=True)
    assert {r.doc_id: r.component_id for r in one.collect()} == comp


def test_texts_of_a_repeated_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, PROSE[0]), (2, PROSE[0]), (2, PROSE[1]), (2, PROSE[1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True)]


def test_word_hashes_over_small_windows(monkeypatch):
    texts = pa.array(["a bb  ccc", None, "", "bb\tCCC a", "ünï bb " * 50, "x" * 300])
    whole = words.word_hashes(texts, lower=True)
    monkeypatch.setattr(words, "WINDOW", 16)
    small = words.word_hashes(texts, lower=True)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    h, first = whole[0], whole[1]
    assert first.tolist() == [0, 3, 3, 3, 6, 106, 107] and h[1] == h[3] and h[2] == h[4] and h[0] == h[5]


def test_near_copies_share_a_bucket():
    rng = np.random.default_rng(1)
    missed = 0
    for n in (4, 12, 40, 400):
        for _ in range(300):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            extra = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)  # similarity of 0.75 and more
            a, b = neardup.signature(np.unique(both)), neardup.signature(np.unique(np.concatenate([both, extra])))
            a, b = neardup.bands(np.stack([a, b]).astype(np.uint64), 0, *neardup.ROUNDS[0])
            missed += not (a == b).any()
    assert missed == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_personal_data_matches_plain_patterns(spark, nasty, empty):
    assert pii.find_personal_data(empty).count() == 0
    texts = [r[1] for r in NASTY] + ["x@y.z. é@é.com ünï 😀 a.b+c@d-e.f-g.h 1.2.3.4.5.6.7.8 001.2.3.4 4111-1111-1111-1112", "4111111111111111 4111111111111111", "++1 2345678901+44 20 7946 0958", " 7" * 9000, "x" * 50_000 + "@a.b", "a@b.c " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        want = _base_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in PLAIN]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.find_personal_data(nasty).count() == len(NASTY)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[9] == texts[9] and clean[0] is None and "[EMAIL]" in clean[11] and not any(_base_spans(t or "") for t in clean.values())


def test_labelers_are_weighed():
    # labeler 0 (3**0) and 1 (3**1) agree on most; a span that both vote for is likelier than one both vote against
    post, prior, tables = pii.reliabilities([(0, 1 + 3, 50.0), (0, 2, 30.0), (0, 1, 5.0), (0, 0, 5.0)])
    assert post[0, 4] > 0.9 > 0.5 > post[0, 2]


def test_reliability_is_of_the_kind_where_it_has_spans():
    # labelers 0 and 2 tell kind 0 apart and 1 votes at random there, on kind 1 it is 1 and 2; kind 2 has a single span
    patterns = [(0, v * (1 + 9) + 3 * w, 200.0) for v in (1, 2) for w in (1, 2)] + [(1, v * (3 + 9) + w, 200.0) for v in (1, 2) for w in (1, 2)] + [(2, 1, 1.0)]
    _, _, tables = pii.reliabilities(patterns)
    told = {k: [t[1][1] - t[0][1] for t in tables[k]] for k in tables}
    assert told[0][0] > told[0][1] + 0.5 and told[1][1] > told[1][0] + 0.5 and told[0][1] < told[2][0] < told[0][0]
    # without spans of their own all kinds share
    _, _, alike = pii.reliabilities(patterns, pull=1e9)
    assert all(abs(alike[0][0][y][v] - alike[1][0][y][v]) < 1e-5 for y in (0, 1) for v in range(3))


def test_candidates_overlap_no_base_span(spark):
    texts = ["card 4111 1111 1111 1111 and +1 415 555 2671", "pay 4111 1111 1111 1111 12 34 5 or call +1 415 555 2671 (2024-05-11 10 30)", "Dear Dr. Maria Lopez, a@b.org"]
    texts += ["+1 415 555 2671 " * 300 + "Mr John Smith 1.2.3.4 " * 300, " ", None]
    rows = {r.row.doc_id: r for r in pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {d: [pii.KINDS[x.ord] for x in r.found] for d, r in rows.items()}
    assert kinds[0] == ["card", "phone"] and sorted(kinds[1]) == ["near_card", "near_phone"] and kinds[2] == ["name", "email"]
    assert kinds[3].count("phone") + kinds[3].count("near_phone") <= 300 and kinds[3].count("name") == kinds[3].count("ip") == 300 and kinds[4] == kinds[5] == []
    for r in rows.values():
        base = [(x.start, x.end) for x in r.found if x.ord < len(pii.BASE)]
        added = [(x.start, x.end) for x in r.found if x.ord >= len(pii.BASE)]
        assert not any(a < y and x < b for a, b in base for x, y in added)


def _planted_spans(n: int = 1500) -> tuple[list[tuple[int, str]], list[set[tuple[str, int, int]]]]:
    """Texts with personal data of the added kinds and look-alikes, with and without words that speak for or against; and where the data are."""
    rng = random.Random(7)
    pick, number = rng.choice, rng.randrange
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    family = "Keller Lopez Smith Novak Brown Garcia Meyer Dubois Rossi Jansen".split()

    def card() -> str:
        while True:
            d = "4" + digits(15)
            if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    data = {
        "name": lambda: f"{pick(['Dr. ', 'Mrs ', ''])}{pick(pii.GIVEN_NAMES)} {pick(family)}",
        "national_id": lambda: f"{number(100, 660)}-{number(10, 99)}-{number(1000, 9999)}",
        "near_card": card, "near_phone": lambda: f"+1 {number(201, 989)} 555 {number(1000, 9999)}",
        "spelled_email": lambda: f"{pick(family).lower()}.{number(99)} (at) {pick(['example', 'mail', 'host'])} (dot) {pick(['org', 'com', 'net'])}",
    }
    cue = {"name": ["dear", "signed by", "contact"], "national_id": ["ssn", "tax id"], "near_card": ["card", "pay by visa"], "near_phone": ["phone", "call"], "spelled_email": ["write to", "e-mail"]}
    after = {"near_card": " 12 34 5", "near_phone": " (2024-05-11 10 30)"}  # the base match is longer and fails
    false = {
        "name": lambda: f"{pick(['Mark', 'Jack', 'Frank', 'Victor', 'Jean'])} {pick(['Schemes', 'Sockets', 'Discussion', 'Ludorum', 'Jackets'])}",
        "national_id": lambda: f"{pick(['000', '666', '987'])}-{pick(['00', '45'])}-{number(1000, 9999)}", "near_card": lambda: "0" + card()[1:],
        "near_phone": lambda: f"+{number(100, 119)} {number(1000, 9999)} 200 {number(1000, 9999)}", "spelled_email": lambda: f"{pick(['noon', 'gate', 'rest'])} (at) gate.{number(10, 99)}",
    }
    plain, against = ["then", "and so", "we saw"], ["see table", "in chapter", "for order"]
    texts, wanted = [], []
    for i in range(n):
        text, spans = "It rained.", set()
        for kind in rng.sample(sorted(data), 2):
            real = rng.random() < 0.6
            lead = pick(cue[kind] + plain if real else plain + against * 2)
            value = (data if real else false)[kind]()
            text += f" So {lead} "
            if real:
                spans.add((kind, len(text), len(text) + len(value)))
            text += value + after.get(kind, "") + ", it is said."
        texts.append((i, text))
        wanted.append(spans)
    return texts, wanted


def test_added_spans_on_planted_data(spark):
    texts, wanted = _planted_spans()
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = [{(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k in pii.ADDED} for i in range(len(texts))]
    figures = {}
    for kind in pii.ADDED:
        of = lambda sets: {(i, *x) for i, s in enumerate(sets) for x in s if x[0] == kind}  # noqa: B023, E731
        right = len(of(found) & of(wanted))
        figures[kind] = right / max(1, len(of(found))), right / len(of(wanted))
    # names without a title, and no word for them before, are the hard ones
    assert all(p >= 0.95 and r >= (0.8 if kind == "name" else 0.98) for kind, (p, r) in figures.items()), figures


def test_added_spans(spark):
    right = {
        "name": "Dear Dr. Maria Lopez, the rain came. Signed by John Smith, who wrote to Mrs Ursula Klein.", "national_id": "Her ssn is 123-45-6789, his tax id 219-09-9999.",
        "spelled_email": "Write to jane.doe (at) example (dot) org or mail bob[at]host.com today.",
    }
    wrong = ["It rained on Tuesday. Paris Match sold well in Main Street.", "Order 000-12-3456 of version 666-00-0000.", "Meet me at noon, dot by dot, in chapter 12."]
    rows = [(i, text) for i, text in enumerate([*right.values(), *wrong] * 5)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, text) in enumerate(right.items()):
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        found = {text[int(a) : int(b)] for k, a, b in spans if k == kind}
        want = {"name": {"Dr. Maria Lopez", "John Smith", "Mrs Ursula Klein"}, "national_id": {"123-45-6789", "219-09-9999"}}
        want["spelled_email"] = {"jane.doe (at) example (dot) org", "bob[at]host.com"}
        assert found >= want[kind] or kind == "name" and len(found & want[kind]) == 3, (kind, found)
    assert all(got[i].spans == "" for i in (3, 4, 5))


def test_redaction(spark, nasty, empty):
    assert pii.redact(empty).count() == 0 and pii.redact(empty).columns == empty.columns
    clashing = nasty.withColumns({"base": F.lit(1), "__base": F.lit(2), "row": F.lit(3), "found": F.lit(4), "gaps_email": F.lit(5)})
    out = pii.redact(clashing)
    assert out.columns == clashing.columns and out.count() == len(NASTY)
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in texts
    (ten,) = [text for doc, text in texts if doc == 10]
    assert ten.startswith("[EMAIL][EMAIL] call ") and ten.endswith(" from [IP] or 256.1.1.1") and "555-6789" not in ten
    assert out.where("row = 3 and base = 1 and spans = 0").count() == len(NASTY)
    # very many spans, and the offsets of a scan in blocks
    many = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    got = pii.redact(spark.createDataFrame([(1, many, 5)], "doc_id long, text string, n_chars long")).first()
    assert got.text == " ".join(["[EMAIL]"] * 3000) and got.n_chars == len(got.text)


def test_packing_round_trip(spark, nasty, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.pack_documents(empty).count() == 0
    docs = spark.createDataFrame([(r[0], r[1]) for r in NASTY if r[0] != 5] + [(50, "It rained. " * 3000)], "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.start)
        assert [x.start for x in own] == np.cumsum([0, *[x.length for x in own]])[:-1].tolist() and sum(x.length for x in own) == len(ids) == own[0].doc_tokens
        assert all(x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in own)
    sequences = defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append(x)
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == np.cumsum([0, *[x.length for x in s]])[:-1].tolist() and sum(x.length for x in s) <= 2048
    assert packing.pack_documents(nasty).select("doc_id").count() >= len(NASTY)


def test_ids_of_all_texts_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    fast = packing._tokenizer(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert list(fast(r.text or "")) == exact.encode(r.text or "", add_special_tokens=False).ids


def test_shards_by_brute_force(spark):
    # sorted in one list: by seeded key within each source, then by fractional rank and source
    import hashlib
    from fractions import Fraction

    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    by = defaultdict(list)
    for doc, source, text in docs:
        by[source].append((hashlib.md5(f"{sharding.SEED}:{doc}".encode()).hexdigest(), len((text or "").encode()) + 8, zlib.crc32((text or "").encode()), doc))
    spread = [(float(Fraction(2 * i + 1, 2 * len(rows))), "n" if source is None else "s" + source, *x) for source, rows in by.items() for i, x in enumerate(sorted(rows))]
    n, want = len(spread), {}
    for rank, (_, _, _, size, crc, doc) in enumerate(sorted(spread)):
        shard = rank * 24 // n
        want[doc] = (size, crc, shard, rank - -(-shard * n // 24))
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == want


def test_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        at = np.cumsum(np.concatenate([[0], rng.integers(1, 9, 40)]))
        price = rng.integers(0, 5, len(at)).astype(float)
        room = 32
        cost = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                size = int(at[j] - at[i])
                if size <= room:
                    cost[j] = min(cost[j], cost[i] + (0 if size & (size - 1) == 0 else room - size) + price[j])
        cuts = packing.best_cuts(at, price, room)
        sizes = np.diff(at[cuts]).tolist()
        assert sum((0 if s & (s - 1) == 0 else room - s) for s in sizes) + sum(price[c] for c in cuts[1:]) == pytest.approx(cost[-1])


def test_language_by_compression(spark, nasty, empty):
    made = {"en": "the rain of that and with", "de": "der regen und nicht mit von", "fr": "la pluie avec une dans les"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(made[lang].split(), 30)), lang, "s", 1) for i, lang in enumerate(list(made) * 30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = langid.learn_dictionaries(docs.where("doc_id % 3 < 3 and doc_id < 45"))
    got = {r.doc_id: r for r in langid.identify_languages(docs, learned).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _, _ in rows]) > 0.97
    odd = {r.doc_id: r for r in langid.identify_languages(nasty, learned).collect() if r.doc_id}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].score == 0 and odd[4].lang_pred in made
    assert langid.identify_languages(empty, learned).count() == 0
    none = langid.identify_languages(docs, langid.learn_dictionaries(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = langid.identify_languages(docs.withColumn("extra", F.lit(1)), learned, keep=True)
    assert kept.columns == [*docs.columns, "extra"] and kept.count() >= 85


def test_language_of_long_texts_is_learned(spark):
    made = {"en": "the rain of that and with ", "de": "der regen und nicht mit von "}
    rows = [(i, made["de"] * 1000, "de", "s", 1) for i in range(20)] + [(100 + i, made["en"] * 3, "en", "s", 1) for i in range(20)]
    dictionaries = langid.learn_dictionaries(spark.createDataFrame(rows, SCHEMA))
    assert sorted(dictionaries) == ["de", "en"] and b"regen und nicht" in dictionaries["de"]
    # of a long text a window inside it teaches, not its beginning only
    late = "x " * 4000 + "zuletzt " * 40_000
    learned = langid.learn_dictionaries(spark.createDataFrame([(i, late, "de", "s", 1) for i in range(20)], SCHEMA))
    assert b"zuletzt" in learned["de"]


def test_language_equals_a_plain_reimplementation(spark):
    # the sizes of the whole text's pieces under each dictionary, counted one by one
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = langid.learn_dictionaries(docs)
    got = {r.doc_id: r for r in langid.identify_languages(docs, dictionaries).collect()}
    for r in docs.collect():
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].rejected
            continue
        plain = " " + " ".join(re.sub(r"[^a-z\x80-\U0010ffff]", " ", r.text.lower()).split(" ")) + " "
        data = b" " + b" ".join(plain.encode().split()) + b" "
        sizes = {}
        for lang, content in dictionaries.items():
            how = z.ZstdCompressionParameters.from_level(
                3, source_size=langid.CHUNK, dict_size=len(content), strategy=z.STRATEGY_LAZY, min_match=4, search_log=4,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            raw = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            one = z.ZstdCompressor(dict_data=raw, compression_params=how)
            sizes[lang] = sum(len(one.compress(data[k : k + langid.CHUNK])) for k in range(0, len(data), langid.CHUNK))
        first, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        if (second[0] - first[0]) / second[0] >= langid.SECOND_LOOK:
            assert got[r.doc_id].lang_pred == first[1] and got[r.doc_id].margin == (second[0] - first[0]) / second[0]


def test_quality_on_held_out_rows(spark, nasty, empty):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) + "."
    bad = lambda: " ".join(x + "!!" for x in rng.choice(["ALPHA", "BETA", "GAMMA"], 40))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 3) for i in range(200, 300))
    odd = quality.score_quality(nasty, model).collect()
    assert len(odd) == len(NASTY) and all(0 <= r.score <= 1 for r in odd)
    assert quality.train_quality(docs, labels.where("quality = 1")) is None and quality.train_quality(empty, labels) is None
    assert quality.score_quality(empty, None).count() == 0


def test_ratios_match_a_plain_count(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta!", "gam-ma", "4711"], 1 + i % 9)), "en", "s", 1) for i in range(80)] + [(80, None, "en", "s", 1), (81, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = {i: int(i % 3 > 0) for i in range(82)}
    got = quality.train_quality(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"))
    n, of = np.zeros((2, 1 << quality.BITS)), [0, 0]
    found = quality.batch_features(pa.array([r[1] for r in rows]))
    for (doc, *_), f in zip(rows, found, strict=True):
        of[marks[doc]] += 1
        n[marks[doc], f] += 1
    p = (n + quality.ALPHA) / (np.array(of)[:, None] + 2 * quality.ALPHA)
    ratio = np.log(p[1] / p[0])
    # all rows are in the sample, so the vectors are those of these rows in the order of their keys
    keys = [hashlib.md5(f"11:{r[0]}".encode()).hexdigest() for r in rows]
    order = sorted(range(len(rows)), key=keys.__getitem__)
    w, b = quality.fit_hinge([found[i] for i in order], np.array([1 if marks[rows[i][0]] else -1 for i in order]), ratio)
    assert got.bias == pytest.approx(b) and np.allclose(got.weight, w * ratio, atol=1e-6)


def test_dual_coordinate_descent_reaches_the_optimum():
    # the squared hinge loss has a closed form once it is known which rows are inside the margin
    rng = np.random.default_rng(9)
    size, scale = 30, rng.normal(size=30)
    rows = [np.flatnonzero(rng.random(size) < 0.3) for _ in range(120)]
    labels = np.array([1 if scale[r].sum() + rng.normal() > 0.3 else -1 for r in rows])
    x = np.zeros((len(rows), size + 1))
    for i, r in enumerate(rows):
        x[i, r], x[i, size] = scale[r], 1
    share = {y: (labels == y).sum() for y in (-1, 1)}
    price = np.array([2 * quality.COST * len(labels) / (2 * share[y]) for y in labels])  # classes weigh alike
    v = np.zeros(size + 1)
    for _ in range(200):
        inside = labels * (x @ v) < 1
        a, c = x[inside], price[inside]
        solved = np.linalg.solve(np.eye(size + 1) + a.T @ (a * c[:, None]), a.T @ (c * labels[inside]))
        if np.allclose(solved, v, atol=1e-12):
            break
        v = solved
    w, b = quality.fit_hinge(rows, labels, scale, epochs=2000)
    assert np.allclose(w, v[:size], atol=1e-6) and b == pytest.approx(v[size], abs=1e-6)
    few, _ = quality.fit_hinge(rows, labels, scale)
    assert np.linalg.norm(few - v[:size]) < 0.05 * np.linalg.norm(v[:size])

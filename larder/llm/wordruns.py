"""Runs of words that repeat periodically, found in a Re-Pair grammar of the word ids.

Frequent neighbours are replaced by nonterminals until no pair is left twice. A run lies in the text of one least node of
the derivation and holds that node's boundary, the place where its two halves meet. So the runs over the boundary are looked
for once a nonterminal, in one of the places that it derives, and hold in all others.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix64

#: A run has at least this many words and this many periods.
LEAST, PERIODS = 6, 4
#: Words of the documents that share a grammar; a longer document has one of its own.
WINDOW = 1 << 19
#: Pairs of a boundary and a period that are tried at once.
TRIED = 1 << 20
_GRAM = 4
Run = tuple[int, int, int]
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string"


class Grammar:
    """Re-Pair of several documents' word ids, many pairs a round.

    ``left``, ``right``, ``length`` and ``at`` describe the nonterminals, from ``first`` on and children before parents:
    two symbols, words, and one place where the nonterminal derives the words. ``symbols``, ``starts`` and ``docs`` are what
    remains of the text: symbols, the place of each and its document.
    """

    def __init__(self, ids: np.ndarray, docs: np.ndarray) -> None:
        self.first = int(ids.max()) + 1 if len(ids) else 0
        self.symbols, self.starts, self.docs = ids, np.arange(len(ids)), docs
        sizes, found = np.ones(len(ids), np.int64), [[] for _ in range(4)]
        alive = np.append(docs[:-1] == docs[1:], False) if len(ids) else np.zeros(0, bool)
        total = self.first
        while True:
            at = np.flatnonzero(alive)
            if not len(at):
                break
            names, which = np.unique(self.symbols[at] * total + self.symbols[at + 1], return_inverse=True)
            apart = _apart(at, which)
            often = np.bincount(which[apart], minlength=len(names))
            alive[at] = often[which] > 1  # a pair never gets more frequent, for new symbols make new pairs
            apart &= often[which] > 1
            at, which = at[apart], which[apart]
            if not len(at):
                break
            # the most frequent pairs first: a pair is replaced where neither neighbour that overlaps it is more frequent; equal
            # ones by a hash, as in an order of names a long rising sequence would change at one end a round
            rank = np.empty(len(names), np.int64)
            rank[np.lexsort((mix64(names.astype(np.uint64)), often))] = np.arange(len(names))
            order = np.full(len(self.symbols) + 2, -1, np.int64)
            order[at + 1] = rank[which]
            best = (order[at + 1] > order[at]) & (order[at + 1] > order[at + 2])
            at, which = at[best], which[best]
            twice = np.bincount(which, minlength=len(names))[which] > 1
            at, which = at[twice], which[twice]
            used, first, which = np.unique(which, return_index=True, return_inverse=True)
            a, b = self.symbols[at[first]], self.symbols[at[first] + 1]
            for held, new in zip(found, (a, b, sizes[at[first]] + sizes[at[first] + 1], self.starts[at[first]]), strict=True):
                held.append(new)
            alive[np.maximum(at - 1, 0)] = True  # the new pairs
            alive[at] = alive[at + 1] = True
            self.symbols = self.symbols.copy()
            self.symbols[at] = total + which
            sizes[at] += sizes[at + 1]
            keep = np.ones(len(self.symbols), bool)
            keep[at + 1] = False
            self.symbols, self.starts, self.docs, sizes, alive = (x[keep] for x in (self.symbols, self.starts, self.docs, sizes, alive))
            alive &= np.append(self.docs[:-1] == self.docs[1:], False)
            total += len(used)
        none = np.zeros(0, np.int64)
        self.left, self.right, self.length, self.at = (np.concatenate(x) if x else none for x in found)


def _apart(at: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which places of pairs don't overlap an equal pair before them, as the second does in a a a."""
    same = np.zeros(len(at), bool)
    same[1:] = (at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])
    begins = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    return (np.arange(len(at)) - begins) % 2 == 0


def _boundaries(grammar: Grammar, n: int) -> tuple[np.ndarray, ...]:
    """lo, mid, hi and owner of every node of the derivation: nonterminals (owner counts from 0) and, where
    the symbols of a document that remained are put under a balanced binary tree, the nodes of that (owner -1)."""
    sizes = np.append(np.ones(grammar.first, np.int64), grammar.length)
    lo, hi = grammar.at, grammar.at + grammar.length
    mid = lo + sizes[grammar.left]
    starts = np.append(grammar.starts, n)
    new = np.flatnonzero(np.diff(grammar.docs, prepend=-1))
    ends = np.append(new[1:], len(grammar.docs)).astype(np.int64)[: len(new)]
    within = np.arange(len(grammar.docs)) - np.repeat(new, ends - new)
    inner = np.flatnonzero(within)
    half = within[inner] & -within[inner]
    top_hi = starts[np.minimum(inner + half, np.repeat(ends, ends - new)[inner])]
    owner = np.append(np.arange(len(lo)), np.full(len(inner), -1))
    lo, mid, hi = np.append(lo, starts[inner - half]), np.append(mid, starts[inner]), np.append(hi, top_hi)
    wide = hi - lo >= LEAST
    return lo[wide], mid[wide], hi[wide], owner[wide]


def _candidates(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, period, place), by node and period: periods that may come twice on one side of a node's boundary, from the place on.

    A run of four periods over a boundary has two of them on one side of it. Short periods are tried one by one,
    longer ones where the four words beside the boundary come again.
    """
    node, n = np.arange(len(lo)), len(ids)
    for q in range(1, _GRAM):
        for place, fits in ((mid, mid + 2 * q <= hi), (mid - 2 * q, mid - 2 * q >= lo)):
            fits = node[fits & (4 * q <= hi - lo)]
            for j in range(q):
                fits = fits[ids[place[fits] + j] == ids[place[fits] + j + q]]
            yield fits, np.full(len(fits), q), place[fits]
    if n <= _GRAM:
        return
    gram = np.zeros(n - _GRAM + 1, np.uint64)
    for j in range(_GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[j : n - _GRAM + 1 + j].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    group = np.cumsum(np.append(0, gram[order[1:]] != gram[order[:-1]])).astype(np.int64)
    key = group * n + order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    quarter = (hi - lo) // 4
    for side in (1, -1):
        limit = np.minimum(quarter, (hi - mid if side > 0 else mid - lo) // 2)
        able = node[limit >= _GRAM]
        spot = rank[mid[able] if side > 0 else mid[able] - _GRAM]
        far = key[spot] + side * limit[able]
        number = np.searchsorted(key, far, "right") - 1 - spot if side > 0 else spot - np.searchsorted(key, far, "left")
        able, spot, number = able[number > 0], spot[number > 0], number[number > 0]
        sums = np.append(0, np.cumsum(number))
        begin = 0
        while begin < len(able):
            end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + TRIED, "right")) - 1)
            part = number[begin:end]
            step = np.arange(int(part.sum())) - np.repeat(sums[begin:end] - sums[begin], part) + 1
            who = np.repeat(able[begin:end], part)
            q = np.abs(order[np.repeat(spot[begin:end], part) + side * step] - order[np.repeat(spot[begin:end], part)])
            place = mid[who] if side > 0 else mid[who] - 2 * q
            good = q >= _GRAM
            for share in (1, 2, 3, 4):
                good[good] = ids[place[good] + q[good] * share // 4 - (share == 4)] == ids[place[good] + q[good] + q[good] * share // 4 - (share == 4)]
            yield who[good], q[good], place[good]
            begin = end


def _crossing(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> dict[int, list[Run]]:
    """For each node its runs (start, end, period) over the boundary, within its text."""
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for who, tried, begins in _candidates(ids, lo, mid, hi):
        nodes, periods, places, at = who.tolist(), tried.tolist(), begins.tolist(), 0
        while at < len(nodes):
            node, q, place = nodes[at], periods[at], places[at]
            at += 1
            if not np.array_equal(ids[place : place + q], ids[place + q : place + 2 * q]):
                continue
            a, m, b = int(lo[node]), int(mid[node]), int(hi[node])
            start = place - _same(ids[a:place][::-1], ids[a + q : place + q][::-1])
            end = place + 2 * q + _same(ids[place + q : b - q], ids[place + 2 * q : b])
            if start < m < end and end - start >= max(LEAST, PERIODS * q):
                seen = found[node]
                seen[start, end] = min(q, seen.get((start, end), q))  # of an interval's periods the smallest
            # two equal halves within this interval are of its period or a multiple, which is the same run
            inside = (end - place if place == m else place + 2 * q - start) // 2
            at = bisect_right(periods, inside, at, bisect_right(nodes, node, at))
    return {node: [(s, e, q) for (s, e), q in runs.items()] for node, runs in found.items()}


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts begin with alike, looking ever further."""
    done, step = 0, 16
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 4
    return len(a)


def _merged(runs: list[Run]) -> list[Run]:
    """Intervals of one period that share a period are one."""
    out: list[Run] = []
    for s, e, q in sorted(set(runs), key=lambda r: (r[2], r[0], -r[1])):
        if out and out[-1][2] == q and s <= out[-1][1] - q:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, q)
        else:
            out.append((s, e, q))
    return out


def grammar_runs(ids: np.ndarray, sizes: list[int]) -> list[list[Run]]:
    """The runs (start, end, period), by start and period, of documents whose word ids lie end to end."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.append(0, np.cumsum(sizes)).astype(np.int64)
    grammar = Grammar(ids, docs)
    lo, mid, hi, owner = _boundaries(grammar, len(ids))
    own: dict[int, list[Run]] = {}
    found: list[list[Run]] = [[] for _ in sizes]
    for node, runs in _crossing(ids, lo, mid, hi).items():
        if owner[node] >= 0:
            a = int(lo[node])
            own[int(owner[node])] = [(s - a, e - a, q) for s, e, q in runs]
        else:
            doc = int(docs[mid[node]])
            found[doc] += [(s - begins[doc], e - begins[doc], q) for s, e, q in runs]
    # what a nonterminal's halves hold it holds too; children come before parents
    first = grammar.first
    if own:
        holds = np.zeros(first + len(grammar.left), bool)
        holds[[first + x for x in own]] = True
        begin = 0
        while begin < len(grammar.left):  # the nonterminals whose halves are all known
            end = begin + int(np.searchsorted(np.maximum.accumulate(np.maximum(grammar.left, grammar.right)[begin:]), first + begin, "left"))
            holds[first + begin : first + end] |= holds[grammar.left[begin:end]] | holds[grammar.right[begin:end]]
            begin = end
        held: dict[int, list[Run]] = {}
        for x in (np.flatnonzero(holds[first:])).tolist():
            a, b = int(grammar.left[x]), int(grammar.right[x])
            shift = int(grammar.length[a - first]) if a >= first else 1
            held[first + x] = _merged(own.get(x, []) + held.get(a, []) + [(s + shift, e + shift, q) for s, e, q in held.get(b, [])])
        for i in np.flatnonzero(holds[grammar.symbols]).tolist():
            doc = int(grammar.docs[i])
            shift = int(grammar.starts[i]) - int(begins[doc])
            found[doc] += [(s + shift, e + shift, q) for s, e, q in held[int(grammar.symbols[i])]]
    return [sorted((int(s), int(e), int(q)) for s, e, q in _merged(runs)) if runs else [] for runs in found]


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, e, q in runs:
        keep[s + q : e] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _described(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    names: dict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(words) for words in texts]
    ids = np.empty(sum(sizes), np.int64)
    at = 0
    for words in texts:
        ids[at : at + len(words)] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        at += len(words)
    found = grammar_runs(ids, sizes)
    flat = np.array([(s, e - s, q) for runs in found for s, e, q in runs], np.int64).reshape(-1, 3)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], ["start", "length", "period"])
    offsets = pa.array(np.append(0, np.cumsum([len(runs) for runs in found])).astype(np.int32))
    collapsed = pa.array([_collapsed(words, runs) for words, runs in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
    columns = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(sizes, pa.int64()), collapsed]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "n_words", "collapsed"])


def word_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, runs (start, length, period: word numbers from 0), n_words and collapsed for every row of ``docs`` (doc_id, text).

    A run is a stretch of words with smallest period q, of LEAST words and PERIODS * q words at least, that can be extended on
    neither side. ``runs`` are by start, then period. ``collapsed`` are the words, joined by one space, that no run holds after
    its first period. Documents of about ``window`` words share a grammar; a longer one is a window of its own.

    Null, empty and wordless texts have no runs and an empty ``collapsed``. Null doc_ids and repeated rows are rows like any other.
    Other columns are not read. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, words = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = (text.as_py() or "").encode().split()  # bytes part at just the six white space characters
                if texts and words + len(found) > window:
                    yield _described(ids, texts)
                    ids, texts, words = [], [], 0
                ids.append(doc_id)
                texts.append(found)
                words += len(found)
            if texts:
                yield _described(ids, texts)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, RUNS)

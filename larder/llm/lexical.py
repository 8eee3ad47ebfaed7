"""Ranked lexical search: an automaton of all terms that are asked for reads each text once a pass; there is no index of documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of an item that are returned.
K = 10
#: Bytes of the terms, with repeats, of the items that are searched for together: the bound of what is broadcast. An item of more is searched for alone.
BLOCK_BYTES = 4 << 20
#: Documents that are scored at once.
_DOCS = 256
#: By byte: lower case for A to Z, a space for what no term holds, other bytes as they are.
_GUARD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_FOUND = "item_id long, doc_id long, score long"


def guarded(text: str | None) -> str:
    """The text with one space or more before and after every term; a character stands for a byte."""
    return " " + (text or "").encode().translate(_GUARD).decode("latin-1") + " "


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each term, between spaces, and yields its place in ``terms``."""
    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        found.add_word(f" {term} ", place)
    found.make_automaton()
    return found


def counted(auto: ahocorasick.Automaton, text: str | None) -> tuple[int, Counter]:
    """The number of all terms of a text, and how often each term of the automaton comes."""
    ready = guarded(text)
    return len(ready.split()), Counter([place for _, place in auto.iter(ready)])


@dataclass
class Query:
    """A block of items: their terms, and for each term the items that hold it and how often."""

    items: list[int]
    terms: list[str]
    begins: np.ndarray
    holders: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Query:
        """From (item, text); rows of one item are one text."""
        texts: dict[int, list[str]] = {}
        for item, text in rows:
            texts.setdefault(item, []).extend(guarded(text).split())
        items = sorted(texts)
        held: dict[str, list[tuple[int, int]]] = {}
        for place, item in enumerate(items):
            for term, n in Counter(texts[item]).items():
                held.setdefault(term, []).append((place, n))
        terms = sorted(held)
        flat = np.array([x for term in terms for x in held[term]], np.int64).reshape(-1, 2)
        begins = np.append(0, np.cumsum([len(held[term]) for term in terms])).astype(np.int64)
        return cls(items, terms, begins, flat[:, 0], flat[:, 1])

    def weights(self, n_docs: int, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _statistics(docs: DataFrame, query) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and for each term of the query the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = query.value.terms
        auto, df, some, total = automaton(terms), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, found = counted(auto, text.as_py())
                some, total = some + (n > 0), total + n
                df[list(found)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [some, total]))], ["term", "n"])

    # a row a term of the block, which is bounded
    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    df = np.array([by.get(i, 0) for i in range(len(query.value.terms))], np.int64)
    return by.get(-1, 0), by.get(-2, 0), df


class _Best:
    """The best k documents of each item so far: by score, then doc_id, null last."""

    def __init__(self, items: list[int], k: int) -> None:
        self.items, self.k = items, k
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        self.worst = np.ones(len(items))

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        for item in np.flatnonzero((scores >= self.worst).any(axis=0)).tolist():
            at = np.flatnonzero(scores[:, item] >= self.worst[item]).tolist()
            new = [(-int(scores[i, item]), ids[i] is None, ids[i] or 0) for i in at]
            best = self.held[item] = sorted(self.held[item] + new)[: self.k]
            if len(best) == self.k:
                self.worst[item] = -best[-1][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(item, None if missing else doc_id, -score) for item, best in zip(self.items, self.held, strict=True) for score, missing, doc_id in best]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])


def _search_block(docs: DataFrame, rows: list[tuple[int, str]], k: int) -> DataFrame:
    """item_id, doc_id and score of the best documents of each task, k an item at most."""
    block = Query.of(rows)
    query = docs.sparkSession.sparkContext.broadcast(block)
    n_docs, n_terms, df = _statistics(docs, query)
    weights = docs.sparkSession.sparkContext.broadcast(block.weights(n_docs, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = query.value, weights.value
        auto, best = automaton(q.terms), _Best(q.items, k)
        for batch in batches:
            for begin in range(0, batch.num_rows, _DOCS):
                part = batch.slice(begin, _DOCS)
                found = [counted(auto, text.as_py()) for text in part.column(1)]
                term = np.array([t for _, f in found for t in f], np.int64)
                tf = np.array([c for _, f in found for c in f.values()], np.int64)
                doc = np.repeat(np.arange(len(found)), [len(f) for _, f in found])
                m = 25 + 75 * np.array([n for n, _ in found], np.int64)[doc] * n_docs // max(n_terms, 1)
                value = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                # each term's value goes to the items that hold it
                fan = q.begins[term + 1] - q.begins[term]
                sums = np.append(0, np.cumsum(fan))
                at = np.arange(sums[-1]) - np.repeat(sums[:-1] - q.begins[term], fan)
                scores = np.zeros(len(found) * len(q.items), np.int64)
                np.add.at(scores, np.repeat(doc, fan) * len(q.items) + q.holders[at], np.repeat(value, fan) * q.times[at])
                best.add(part.column(0).to_pylist(), scores.reshape(len(found), -1))
        yield best.batch()

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; buckets of hashed ids are put together, so only their sizes are gathered."""
    parted = items.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(4096)))
    sizes = sorted((r.bucket, r.bytes) for r in parted.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("bytes")).collect())  # 4096 rows at most
    block, held = [], 0
    for bucket, size in [*sizes, (None, 0)]:
        if block and (bucket is None or held + size > block_bytes):
            yield [(r.item_id, r.text) for r in parted.where(F.col("bucket").isin(block)).collect()]  # block_bytes at most, or one bucket
            block, held = [], 0
        block.append(bucket)
        held += size


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: of each item (item_id, text) the ``k`` documents (doc_id, text) of highest score above 0.

    Terms match TERM, A to Z lower-cased. Every text is read twice for a block of items: once for the numbers of documents and
    terms, once for the scores, so nothing of the size of the documents is kept between. A task keeps k documents an item.

    Equal scores rank by doc_id, null last; each row of documents is a document, repeated ones too. Null and empty
    texts have no terms. Equal rows of items count once, different texts of one item_id are one text; a null
    item_id is no item. Other columns are not read. No documents or no items give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for rows in _blocks(asked, block_bytes):
        found = found.unionByName(_search_block(docs, rows, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

"""Order MinHash fingerprints of whole texts, and their likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import mix64

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TUPLE, SLOTS = 5, 2, 32
_ODD = np.random.default_rng(4099).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers come before each."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    at = np.arange(len(kmers))
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    out = np.empty(len(kmers), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def order_minhash(text: str) -> np.ndarray:
    """SLOTS 32-bit values. Under each of SLOTS hash orders the TUPLE least (k-mer, occurrence)
    pairs are selected; their k-mers, put in text order, are hashed as a tuple.

    A text of fewer than K code points is one k-mer; the empty text has none and gets zeros.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return np.zeros(SLOTS, np.uint32)
    k = min(K, len(points))
    kmers = np.zeros(len(points) - k + 1, np.uint64)
    for j in range(k):
        kmers *= np.uint64(0x100000001B3)
        kmers += points[j : j + len(kmers)]
    kmers = mix64(kmers)
    numbered = mix64(kmers + occurrences(kmers) * _STEP) if len(kmers) > 1 else kmers
    picked = np.empty((SLOTS, min(TUPLE, len(kmers))), np.int64)
    ranks = np.empty(len(numbered), np.uint64)
    for slot in range(SLOTS):
        np.multiply(numbered, _ODD[slot], out=ranks)
        for j in range(picked.shape[1]):
            i = picked[slot, j] = int(ranks.argmin())
            ranks[i] = _TOP
    picked.sort(axis=1)
    value = np.full(SLOTS, len(picked[0]), np.uint64)
    for j in range(picked.shape[1]):
        value = mix64(value * _STEP + kmers[picked[:, j]])
    return (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the text, rounded down, replaced by as many first code points of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _row(doc, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = order_minhash(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, after)


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in schema.split(", "))])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A fingerprint of every whole text and of its edited text, by descending doc_id.

    Texts are dealt out by ranges of doc_id, descending, so that the next document is
    mostly the next row of the same task; only the first and last text of each range meet
    in a second step, by a table of ranges that has one row per task. After the last
    document comes the first. Null text is empty. Null doc_id comes last. Rows of equal
    doc_id follow each other by a hash of the text, then by text; a lone row follows
    itself. Other columns are not read. No rows give no rows.
    """
    wide = RESULT + ", part int, first_text string, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            held = None
            for batch in batches:
                texts = batch.column(1)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    text = texts[k].as_py() or ""
                    own = order_minhash(text)
                    if held:
                        yield (*_row(*held[:3], text, own), part, held[3], None)
                    held = (doc, text, own, None if held else text)
            if held:
                doc, text, own, first = held
                yield doc, len(text), None, as_text(own), None, None, None, part, first, text

        yield from _batches(rows(), _arrow(wide))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    own, after = (np.frombuffer(bytes.fromhex(r[c]), ">u4").astype(np.uint32) for c in ("fingerprint", "next_fingerprint"))
                    yield _row(r["doc_id"], r["last_text"], own, r["next_text"], after)

        yield from _batches(rows(), _arrow(RESULT))

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    # what a range's first text has as fingerprint is needed beside its text
    done = written(ranged.mapInArrow(run, wide), "fingerprints")
    names = [f.split()[0] for f in RESULT.split(", ")]
    firsts = done.where(F.col("first_text").isNotNull())
    ranges = firsts.select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    ranges = ranges.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    following = firsts.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = done.where(F.col("last_text").isNotNull()).select("doc_id", "last_text", "fingerprint", "part")
    closed = lasts.join(ranges, "part").join(following, "next_part").select("doc_id", "last_text", "fingerprint", "next_text", "next_fingerprint")
    return done.where(F.col("last_text").isNull()).select(*names).unionByName(closed.mapInArrow(close, RESULT))

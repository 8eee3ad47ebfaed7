"""Order-preserving packing of token streams by dynamic programming with a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE = 2048
TOKENIZER, RANKS, END_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 1
SPECIAL = "<|endoftext|>"
#: Costs in tokens of padding: a cut inside a document after a sentence, and anywhere else.
SENTENCE_CUT, FORCED_CUT = 4.0, 24.0
#: What a sequence costs besides its padding, so that a short one at a power of two is not free.
SEQUENCE_COST = 32.0
#: Sentence ends nearer than this to the last boundary are no boundaries; gaps wider than the second get forced ones.
MIN_GAP, MAX_GAP = 24, 96
#: Tokens whose cuts are chosen together.
CHUNK = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: np.ndarray, penalty: np.ndarray, room: int = SEQUENCE) -> list[int]:
    """Indexes into ``at`` of the cheapest cuts, the first and last included.

    ``at`` holds rising token positions where a cut may be, at most ``room`` apart.
    A sequence between two cuts costs its padding, ``room`` less its length, or nothing
    at a power of two; a cut costs its penalty. As the padding is linear in the position,
    the cheapest predecessor in the window of ``room`` tokens is the head of a monotone
    queue of cost + position; powers of two are eleven single lookups.
    """
    pos = at.tolist()
    n = len(pos)
    where = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(room.bit_length()) if 1 << k < room]
    cost, came = [0.0] * n, [0] * n
    pen = penalty.tolist()
    queue: deque[tuple[float, int, int]] = deque([(float(pos[0]), pos[0], 0)])
    find = where.get
    for j in range(1, n):
        p = pos[j]
        while p - queue[0][1] > room:
            queue.popleft()
        key, _, best = queue[0]
        least = key + room - p
        for step in powers:
            i = find(p - step)
            if i is not None and cost[i] < least:
                least, best = cost[i], i
        least += pen[j]
        cost[j], came[j] = least, best
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def boundaries(ids: np.ndarray, document_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and what each cut costs: document ends nothing, sentence ends a little, forced ones more."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    stops = np.flatnonzero(ends_sentence[ids]) + 1
    if len(stops):  # of each stretch of MIN_GAP tokens, its first sentence end
        stops = stops[np.unique(stops // MIN_GAP, return_index=True)[1]]
    price[stops] = SENTENCE_CUT
    price[document_ends] = 0.0
    price[0] = price[n] = 0.0
    at = np.flatnonzero(np.isfinite(price))
    wide = np.flatnonzero(np.diff(at) > MAX_GAP)
    for i in wide.tolist():
        price[np.arange(at[i] + MAX_GAP, at[i + 1], MAX_GAP)] = FORCED_CUT
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def _tokenizer(tokenizer_path: str, ranks_path: str) -> Callable[[str], list[int]]:
    """A function from text to ids, with ends_sentence: for each id whether a sentence may end with it.

    tiktoken over the same vocabulary gives the same ids several times faster; a text that
    spells the special token goes through the tokenizers library itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if SPECIAL not in text:
            return fast.encode_ordinary(text)
        if not exact:
            exact.append(Tokenizer.from_file(tokenizer_path))
        return exact[0].encode(text, add_special_tokens=False).ids

    ends = np.zeros(max(ranks.values()) + 2, dtype=bool)
    for token, i in ranks.items():
        ends[i] = token.rstrip(b"\"')").endswith((b".", b"!", b"?", b"\n"))
    ends[END_ID] = False
    encode.ends_sentence = ends
    return encode


def pack_stream(stream: Iterator[tuple[int | None, np.ndarray]], ends_sentence: np.ndarray, base: int, chunk: int = CHUNK, room: int = SEQUENCE) -> Iterator[tuple]:
    """Pieces of documents, in order. Cuts are chosen for about ``chunk`` tokens at once; the
    unfinished last sequence of a chunk moves on into the next one."""
    held: list[tuple] = []  # (doc_id, ids, ids of the document before these, its ids in all)
    size, sequence = 0, base

    def flush(last: bool):
        nonlocal held, size, sequence
        ids = np.concatenate([h[1] for h in held])
        ends = np.cumsum([len(h[1]) for h in held])
        at, price = boundaries(ids, ends, ends_sentence)
        cuts = at[best_cuts(at, price + SEQUENCE_COST, room)]
        stop = int(cuts[-1] if last or len(cuts) < 3 else cuts[-2])
        out, k, done = [], 0, 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > stop:
                break
            offset = 0
            while offset < b - a:
                doc, own, before, whole = held[k]
                take = min(b - a - offset, len(own) - done)
                piece = own[done : done + take]
                out.append((doc, before + done, take, zlib.crc32(piece.astype("<u4").tobytes()), whole, sequence, offset))
                offset, done = offset + take, done + take
                if done == len(own):
                    k, done = k + 1, 0
            sequence += 1
        held = held[k:]
        if held and done:
            doc, own, before, whole = held[0]
            held[0] = (doc, own[done:], before + done, whole)
        size = sum(len(h[1]) for h in held)
        return out

    for doc, ids in stream:
        for k in range(0, len(ids), chunk):
            part = ids[k : k + chunk]
            held.append((doc, part, k, len(ids)))
            size += len(part)
            if size >= chunk:
                yield from flush(False)
    if held:
        yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, room: int = SEQUENCE) -> DataFrame:
    """The pieces of every document in sequences of at most ``room`` tokens.

    Each input partition is one stream in its own order and is packed alone; only its last
    sequence may be short for want of documents. A document's ids are its text's and then
    id 1, so a null or empty text is the one id 1. Documents longer than a sequence are cut
    at sentence ends, of which one in MIN_GAP tokens is tried, or every MAX_GAP tokens where there are none; the
    cuts are the best of these for CHUNK tokens at a time. Repeated rows are packed
    as often as they come; null doc_id stays null. sequence_id is partition * 2**32 + number.
    Other columns are not read. No rows give no rows.
    """
    import public_tokenizers

    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_path, ranks_path)
        kinds = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

        def stream():
            for batch in batches:
                texts = batch.column(1)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    yield doc, np.array([*encode(texts[k].as_py() or ""), END_ID], np.int64)

        rows: list[tuple] = []
        for row in pack_stream(stream(), encode.ends_sentence, TaskContext.get().partitionId() << 32, room=room):
            rows.append(row)
            if len(rows) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(pack, SCHEMA)

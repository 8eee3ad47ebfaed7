"""Approximate nearest neighbours: an inverted file of coarse centroids, product-quantised residuals, asymmetric distance tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import mix64

#: Bound of the sample that the index is fitted on (of vectors); there are 4 * sqrt(n) cells, a fourth of the sample at most.
FIT_VECTORS = 16384
#: Components of a quantised part, codes of a part.
PART, CODES = 2, 64
#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 32768, 4096
#: Candidates of a query and block that are ranked by products in Spark, by distance tables in the first look, by products in the second.
RERANK = 96
#: Share of all cells for the first look.
FIRST_SHARE = 0.02
#: Share of the lengths of what is added up that rounding may take from a bound.
ROUNDING = 1e-5
K = 20


@dataclass
class Index:
    """Coarse centroids (cells x d), codebooks (parts x CODES x PART, zero-padded), the longest residual of each cell."""

    centroids: np.ndarray
    books: np.ndarray
    radius: np.ndarray | None = None

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = (self.centroids**2).sum(axis=1) / 2
        return np.argmax(vectors @ self.centroids.T - half, axis=1)

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        """Bytes of each residual: its length, how far its code is from it, then the codes of its direction, so that short
        residuals, in dense groups, are told apart as well as long ones."""
        length, parts = _directions(residuals)
        codes = np.stack([np.argmax(parts[:, m] @ b.T - (b**2).sum(axis=1) / 2, axis=1) for m, b in enumerate(self.books)], axis=1)
        off = sum(((parts[:, m] - b[codes[:, m]]) ** 2).sum(axis=1) for m, b in enumerate(self.books))
        numbers = np.stack([length, length * np.sqrt(off)], axis=1).astype("<f8")
        return np.concatenate([numbers.view(np.uint8).reshape(len(length), -1), codes.astype(np.uint8)], axis=1)


def _parts(vectors: np.ndarray) -> np.ndarray:
    n, d = vectors.shape
    wide = np.zeros((n, -(-d // PART) * PART))
    wide[:, :d] = vectors
    return wide.reshape(n, -1, PART)


def _directions(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(residuals, axis=1)
    return length, _parts(residuals / np.where(length > 0, length, 1.0)[:, None])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    k = min(k, len(x))
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T - (centers**2).sum(axis=1) / 2, axis=1)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centers[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centers


def fit_index(sample: np.ndarray, cells: int) -> Index:
    centroids = _kmeans(sample, cells, 8, 1)
    index = Index(centroids, np.zeros((0, 1, PART)))
    _, parts = _directions(sample - centroids[index.cells(sample)])
    return Index(centroids, np.stack([_kmeans(parts[:, m], CODES, 6, 2 + m) for m in range(parts.shape[1])]))


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    wide = embedding.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(wide, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _bytes_of(column: pa.ChunkedArray, kind: type, rows: int) -> np.ndarray:
    """Equally long binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


@dataclass
class Search:
    """How a query picks cells and candidates: which looks at which cells, and how candidates are scored."""

    index: Index
    first_share: float
    rerank: int
    exact: bool

    def probes(self, queries: np.ndarray, worst: np.ndarray | None) -> np.ndarray:
        """Whether each query looks at each cell: without ``worst`` at its nearest ones, else at all that could hold a
        score as good as ``worst``; where that is -inf, at all."""
        centroids = self.index.centroids
        n = len(centroids)
        near, lengths = queries @ centroids.T, np.linalg.norm(centroids, axis=1)
        if worst is None:
            order = np.argsort(-near / np.maximum(lengths, 1e-12), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(n)[None, :], axis=1)
            return rank < min(n, max(2, math.ceil(self.first_share * n)))
        bound = near + np.linalg.norm(queries, axis=1)[:, None] * (self.index.radius + ROUNDING * (self.index.radius + lengths))
        return ~(bound < worst[:, None])

    def scores(self, queries: np.ndarray, vectors: np.ndarray, cell: int, worst: np.ndarray | None) -> np.ndarray:
        """Products of queries with the vectors of a cell, from tables of products with the codes, or exact ones. With ``worst``
        the exact ones of the vectors whose code, with how far it may be from its vector, allows one that good; -inf for others."""
        if self.exact:
            return queries @ vectors.T
        parts, books, centroid = _parts(queries), self.index.books, self.index.centroids[cell]
        length, off = np.ascontiguousarray(vectors[:, :16]).view("<f8").T
        codes = vectors[:, 16 : 16 + len(books)]
        near = np.zeros((len(queries), len(vectors)))
        for m, book in enumerate(books):
            near += np.take(parts[:, m] @ book.T, codes[:, m], axis=1)
        near = near * length + (queries @ centroid)[:, None]
        if worst is None:
            return near
        off = off + ROUNDING * (length + np.linalg.norm(centroid))
        hopeless = near + np.linalg.norm(queries, axis=1)[:, None] * off < worst[:, None]
        some = np.flatnonzero(~hopeless.all(axis=0))
        near[:, some] = queries @ np.ascontiguousarray(vectors[some, 16 + len(books) :]).view("<f8").T
        near[hopeless] = -np.inf
        return near

    def tile(self, coded: pa.Table, asked: pa.Table) -> pa.Table:
        """The best candidates of a block of vectors for each query of a block, as many as are reranked."""
        out: list[tuple] = []
        if coded.num_rows and asked.num_rows:
            coded = coded.sort_by([("cell", "ascending"), ("rep", "ascending")])
            reps, cells = coded["rep"].to_numpy(), coded["cell"].to_numpy()
            held = _bytes_of(coded["payload"], np.float64 if self.exact else np.uint8, len(reps))
            names, queries = asked["query"].to_numpy(), _bytes_of(asked["vec"], np.float64, asked.num_rows)
            worst = asked["worst"].to_numpy() if "worst" in asked.column_names else None
            begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            ends = np.append(begins[1:], len(cells))
            keep = min(self.rerank, len(reps))
            for k in range(0, len(queries), step := max(16, 4_000_000 // len(reps))):
                q, w = queries[k : k + step], None if worst is None else worst[k : k + step]
                looks = self.probes(q, w)
                near = np.full((len(q), len(reps)), -np.inf)
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    at = np.flatnonzero(looks[:, cells[a]])
                    if len(at):
                        near[at, a:b] = self.scores(q[at], held[a:b], int(cells[a]), None if w is None else w[at])
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < len(reps) else np.broadcast_to(np.arange(len(reps)), near.shape)
                found = np.take_along_axis(near, best, 1)
                some = np.isfinite(found)
                out.append((np.repeat(names[k : k + step], some.sum(axis=1)), reps[best[some]], found[some]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query", "rep", "near"), columns, strict=True)))


def _best(found: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(score), "rep")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, fit_vectors: int = FIT_VECTORS, first_share: float = FIRST_SHARE,
    rerank: int = RERANK, exact: bool = False, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by largest inner product.

    ``vectors`` has vec_id and embedding; ``is_query`` says which rows are queries.
    1. Equal vectors are one entry, with its k + 1 least vec_ids; more can't be in a result.
    2. Centroids and codebooks are fitted on at most ``fit_vectors`` vectors of least hash; every
       vector is indexed. There are 4 * sqrt(n) cells, a fourth of ``fit_vectors`` at most.
    3. Blocks of about ``block`` vectors, whole cells where these are not larger, meet blocks of about
       ``query_block`` queries.
    4. A query looks into its nearest ``first_share`` of the cells, where tables of products with the codes pick
       the ``rerank`` best; exact products of these give a score that the k + 1 nearest reach at least.
    5. Then it looks into all cells where centroid product plus the longest residual could reach that score, and there at
       the vectors whose code product plus the code's distance from the vector could. None that could is left out, so the
       rows themselves only decide how much is compared, not what is found. What travels is a vector and its code.
    6. The ``rerank`` best of these by product are fetched and ranked by exact products in double precision. Ties go to
       the smaller vec_id.

    ``exact`` compares each query with all vectors in double precision without an index; first_share
    and rerank don't matter then.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    vec_ids or vectors of another length than the most frequent one. Repeated rows are one
    candidate; a vec_id with several vectors is a query once for each. With fewer than k
    candidates all are returned. Other columns are not read. No rows give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == length[0]["d"])
    kept = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = kept.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.max("asks").alias("any"))
    asking = rows.where("asks").groupBy("vec").agg(F.lit(True).alias("asks"))
    entries = entries.join(asking, "vec", "left").select(F.col("ids")[0].alias("rep"), "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    entries = written(entries, "vectors")

    n = entries.count()
    few = math.ceil(2 * fit_vectors / max(n, 1) * (1 << 20))  # twice the share that is wanted, so that the sort has a bound
    sample = entries.where(F.expr(f"pmod(xxhash64(rep), {1 << 20})") < few).orderBy(F.xxhash64("rep"), "rep").limit(fit_vectors).select("vec").toArrow()
    index = fit_index(sample["vec"].combine_chunks().values.to_numpy().reshape(len(sample), -1), max(1, min(fit_vectors // 4, round(4 * math.sqrt(n)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist())
            if len(x):
                cell = index.cells(x)
                rest = x - index.centroids[cell]
                whole = pa.array([v.tobytes() for v in x], pa.binary())
                code = whole if exact else pa.array([v.tobytes() for v in index.encode(rest)], pa.binary())
                far = pa.array(np.linalg.norm(rest, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), code, whole, far], ["rep", "cell", "payload", "whole", "far"])

    coded = written(entries.select("rep", "vec").mapInArrow(assign, "rep long, cell int, payload binary, whole binary, far double"), "coded")
    sizes = coded.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()  # a row per cell
    radius = np.full(len(index.centroids), -np.inf)
    radius[sizes["cell"].to_numpy()] = sizes["far"].to_numpy() * (1 + 1e-9)
    index.radius = radius
    held = np.zeros(len(index.centroids), np.int64)
    held[sizes["cell"].to_numpy()] = sizes["n"].to_numpy()
    # consecutive cells share blocks; a cell larger than a block has several of its own
    room = max(1, min(block, math.ceil(n / spark.sparkContext.defaultParallelism)))
    first_block = (np.cumsum(held) - held) // room
    last_block = np.maximum(first_block, (np.cumsum(held) - 1) // room)
    queries = entries.where("asks").select(F.col("rep").alias("query"), "vec")
    query_blocks = 1 + queries.count() // query_block
    search = Search(index, 1.0 if exact else first_share, k + 1 if exact else max(rerank, k + 1), exact)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rep = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            width = last_block[cell] - first_block[cell] + 1
            to = first_block[cell] + (mix64(rep.view(np.uint64)) % width.astype(np.uint64)).astype(np.int64)
            for part in range(query_blocks):
                where = [pa.array(to.astype(np.int32)), pa.array(np.full(len(to), part, np.int32))]
                yield pa.RecordBatch.from_arrays([*where, *(batch.column(i) for i in range(3))], ["block", "part", "rep", "cell", "payload"])

    def ask(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                q = _matrix(piece.column(1).to_pylist())
                if not len(q):
                    continue
                worst = np.array([-np.inf if w is None else w for w in piece.column(2).to_pylist()]) if again else None
                i, cell = np.nonzero(search.probes(q, worst) & (held > 0))
                spans = last_block[cell] - first_block[cell] + 1
                i, to = np.repeat(i, spans), np.repeat(first_block[cell], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                pairs = np.unique(i * (int(last_block.max()) + 1) + to)
                i, to = np.divmod(pairs, int(last_block.max()) + 1)
                name = piece.column(0).to_numpy()[i]
                part = (mix64(name.view(np.uint64)) % np.uint64(query_blocks)).astype(np.int32)
                raw = [v.tobytes() for v in q]
                columns = [pa.array(to.astype(np.int32)), pa.array(part), pa.array(name), pa.array([raw[j] for j in i], pa.binary())]
                extra = [pa.array(worst[i])] if again else []
                yield pa.RecordBatch.from_arrays(columns + extra, ["block", "part", "query", "vec", *(["worst"] if again else [])])

    def dealt(again: bool) -> DataFrame:
        payload = F.concat("payload", "whole") if again else F.col("payload")
        return coded.select("rep", "cell", payload.alias("payload")).mapInArrow(deal, "block int, part int, rep long, cell int, payload binary")

    def found(asked: DataFrame, again: bool) -> DataFrame:
        """query, rep, score: the best of a look, by exact products."""
        kind = "block int, part int, query long, vec binary" + (", worst double" if again else "")
        probes = asked.mapInArrow(lambda b: ask(b, again), kind)
        pairs = dealt(again).groupBy("block", "part").cogroup(probes.groupBy("block", "part"))
        near = pairs.applyInArrow(lambda v, q: search.tile(v, q), "query long, rep long, near double")
        near = _best(near, "near", search.rerank)
        if exact:
            return near.withColumnRenamed("near", "score")
        both = near.join(entries.select("rep", "vec").hint("merge"), "rep").join(queries.select("query", F.col("vec").alias("asked")).hint("merge"), "query")
        product = F.aggregate(F.zip_with("vec", "asked", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        return both.select("query", "rep", product.alias("score"))

    one = written(_best(found(queries, False), "score", k + 1), "first-look")
    best = one
    if not exact:
        worst = one.groupBy("query").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        worst = worst.select("query", F.when(F.col("n") > k, F.col("worst")).alias("worst"))
        # the second look finds all of the first that count once more
        best = _best(found(queries.join(worst.hint("merge"), "query", "left"), True), "score", k + 1)
    ids = best.join(entries.select("rep", F.explode("ids").alias("vec_id")), "rep").select("query", "vec_id", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    askers = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    askers = askers.join(entries.select("vec", F.col("rep").alias("query")), "vec").select("query_id", "query")
    mine = askers.join(lists, "query").withColumn("list", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return mine.select("query_id", F.posexplode("list").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")

"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import written
from .words import mix64, shingle_sets

#: Words of a shingle, and bins of a signature, each with the least hash of its share of the shingles.
WIDTH, BINS = 5, 128
#: Rounds of (bins of a band, bands). All nodes take part in the first, in each further one those still in doubt.
#: At a similarity of 0.75 a pair shares no bucket of the first round once in 200,000.
ROUNDS = ((4, 32), (6, 64))
#: Least hashes of what a hub lacks of a member that doesn't link with it; members that share one are candidates in turn.
RESIDUE = 64
#: Bins of two signatures, of BINS, that must agree for a pair that only a residue found to be worth reading;
#: at a similarity of 0.75 fewer agree once in a million pairs.
AGREE = 72
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Spokes of a hub that are checked by one task at once.
SPOKES = 256
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: For each bin the order in which it asks the others; an empty bin copies the first that is not.
_ASKS = np.argsort(np.argsort(np.random.default_rng(77).random((BINS, BINS)), axis=1), axis=1)
SIGNED = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, bins binary"


def signature(found: np.ndarray) -> np.ndarray:
    """BINS 32-bit values for a sorted, non-empty set of hashes. The top bits of a hash name its bin, so the
    one permutation is the hash itself and the first of each bin its minimum; an empty bin takes
    the value of the bin it would ask first of those that are filled (optimal densification)."""
    bins = (found >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = bins[first]
    value = np.zeros(BINS, np.uint64)
    value[filled] = found[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, dtype=bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        value[empty] = value[filled[_ASKS[np.ix_(empty, filled)].argmin(axis=1)]]
    return mix64(value).astype(np.uint32)


def bands(signed: np.ndarray, turn: int, rows: int, count: int) -> np.ndarray:
    """Buckets (signatures x count) of a round; each band hashes ``rows`` bins, dealt anew for every round."""
    deal = np.random.default_rng(turn)
    picked = np.concatenate([deal.permutation(BINS) for _ in range(-(-rows * count // BINS))])[: rows * count].reshape(count, rows)
    picked = np.arange(rows * count).reshape(count, rows) if rows * count == BINS else picked
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(turn << 32), (len(signed), count))
    for j in range(rows):
        out = mix64(out * _ODD + signed[:, picked[:, j]])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), WIDTH)
            h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            h2 = np.array([mix64(s ^ _ODD).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            bins = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), batch.column(1), sizes, pa.array(h1), pa.array(h2), bins]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "h1", "h2", "bins"])

    text = docs["text"].cast("string")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return slim.mapInArrow(run, SIGNED)


def text_key(text: Column) -> Column:
    """Tells the texts of a repeated doc_id apart."""
    return F.xxhash64(text)


def bucketed(sets: DataFrame, turn: int, rows: int, count: int) -> DataFrame:
    """bucket, node, size and n: the members of all buckets of more than one node, and how many a bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                signed = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint32).reshape(-1, BINS).astype(np.uint64)
                found = bands(signed, turn, rows, count).ravel().view(np.int64)
                each = [pa.array(np.repeat(piece.column(i).to_numpy(), count)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *each], ["bucket", "node", "size"])

    return _crowded(sets.select("node", "size", "bins").mapInArrow(run, "bucket long, node long, size long"))


def _crowded(buckets: DataFrame) -> DataFrame:
    """The rows of buckets of more than one node, with n, how many the bucket has."""
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return buckets.join(many.hint("merge"), "bucket")


def stars(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Candidate edges (a, b, part): every member of a bucket to the bucket's hub, fewer edges than members.

    The hub is the member that shares buckets with the most others (then of least node), so in a group of
    near copies it is the text that the copies were made from rather than one of its far relatives.
    Members of the hub's component need no edge. Those of too different size can't link, but what the hub lacks of them
    may show what else they link with.
    """
    popular = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("popular"))
    ranked = members.join(popular.hint("merge"), "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("popular", (-F.col("node")).alias("minus"))).alias("hub"))
    hubs = hubs.select("bucket", (-F.col("hub.minus")).alias("b"))
    spokes = members.join(hubs.hint("merge"), "bucket").where(F.col("node") != F.col("b"))
    edges = spokes.groupBy(F.col("node").alias("a"), "b").agg(F.max("n").alias("n"))
    if labels is not None:
        edges = _labelled(_labelled(edges, labels, "a"), labels, "b").where("a_comp != b_comp")
    return edges.select("a", "b", F.expr(f"pmod(xxhash64(a), 1 + n div {SPOKES})").alias("part"))


def agreeing(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges whose ends agree in AGREE bins or more of their signatures; no text is read for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BINS) for i in (3, 4))
            yield batch.filter(pa.array((one == two).sum(axis=1) >= AGREE)).select(["a", "b", "part"])

    for end, bins in (("a", "bins_a"), ("b", "bins_b")):
        edges = edges.join(sets.select(F.col("node").alias(end), F.col("bins").alias(bins)).hint("merge"), end)
    return edges.select("a", "b", "part", "bins_a", "bins_b").mapInArrow(run, "a long, b long, part long")


def confirmed(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b): ``linked`` if their full shingle sets are similar enough, else ``residue``, the RESIDUE least hashes of
    the shingles of a that b lacks.

    The spokes ``a`` of a hub ``b`` meet it by ``part``, SPOKES or so at once, so a hub of very many
    spokes is split and its text repeated once a part; a task holds one hub's set at a time.
    """
    spokes = edges.join(texts.withColumnRenamed("node", "a").hint("merge"), "a").select("b", "part", F.col("a").alias("node"), "text")
    hubs = edges.select("b", "part").distinct().join(texts.withColumnRenamed("node", "b").hint("merge"), "b")
    hubs = hubs.select("b", "part", F.col("b").alias("node"), "text")
    together = hubs.unionByName(spokes).withColumn("role", (F.col("node") != F.col("b")).cast("int"))
    together = together.repartition("b", "part").sortWithinPartitions("b", "part", "role").select("b", "part", "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, key = [], None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                found: list[tuple[int, int, bool, list[int] | None]] = []
                keys = zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True)
                for (b, part, role, node), s in zip(keys, shingle_sets(piece.column(4), WIDTH), strict=True):
                    if role == 0:  # rows of one doc_id may hold several texts
                        hub, key = ([*hub, s] if key == (b, part) else [s]), (b, part)
                    elif any(similar(s, h) for h in hub):
                        found.append((node, b, True, None))
                    else:
                        lacking = np.setdiff1d(s, np.concatenate(hub), assume_unique=False) if hub else s
                        found.append((node, b, False, lacking[:RESIDUE].view(np.int64).tolist()))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["a", "b", "linked", "residue"])

    return together.mapInArrow(run, "a long, b long, linked boolean, residue array<long>")


def residues(checked: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """bucket, node, size and n: nodes that do not link with one hub and share a shingle that this hub lacks.

    What all members of a bucket have in common, as a passage that half of each repeats, is the hub's as well, so it drops out and what
    only some of them share is left. Hubs whose spokes are of one component tell nothing new.
    """
    loose = _labelled(checked.where("not linked").select("a", "b", "residue"), labels, "a")
    several = loose.groupBy("b").agg(F.min("a_comp").alias("low"), F.max("a_comp").alias("high")).where("low != high")
    open_ = loose.join(several.select("b").hint("merge"), "b", "left_semi")
    buckets = open_.select(F.col("a").alias("node"), "b", F.explode("residue").alias("shingle")).select(F.xxhash64("b", "shingle").alias("bucket"), "node")
    return _crowded(buckets).join(sizes.select("node", "size").hint("merge"), "node")


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets have 100 * intersection >= PERCENT * union."""
    if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(s) + len(t) - both)


def near_duplicates(docs: DataFrame, rounds: tuple[tuple[int, int], ...] = ROUNDS, exhaustive: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key for every row.

    1. Rows of equal shingle sets become one node, the least doc_id of them (pre-aggregated,
       so a group of a third of all rows is one row per task).
    2. Each node goes into a bucket per band of the first of ``rounds``. The members of a bucket get an
       edge to its hub only (``stars``), so a bucket of n nodes makes n - 1 candidate edges, not all pairs.
       Every edge is checked on the full sets; linked nodes are one component.
    3. Members of a bucket that don't link with its hub go, by the shingles that the hub lacks, into buckets of their own, so that
       what links only with each other meets even where a passage that very many documents share fills the signatures.
       Candidates found so are checked as before.
    4. Nodes in doubt are those of buckets that still hold several components. They go into the buckets
       of the next round, whose bands are others and longer, so that what is less similar than a link
       parts and what is linked gets a hub of its own. A round makes at most its number of bands of edges a node, and
       RESIDUE for each of them, whatever the groups are like: work grows with the rows.
    5. ``exhaustive`` then makes every node in doubt a hub of its buckets, one after the other, until all
       pairs of a first-round bucket are linked, checked, or joined otherwise. It finds what the rounds may
       have missed, but is quadratic in the nodes of a bucket that don't link.

    Null or wordless texts have size 0 and link with nothing: component_id is the doc_id.
    A null doc_id links with nothing and is kept, with component_id null. Rows of one doc_id are one
    document: repeated rows get equal results. Rows of one doc_id with several texts differ by text_key.
    Other columns are not read. No rows give no rows.
    """
    rows = written(signatures(docs), "signatures")
    linkable = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = linkable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "bins")).alias("least"))
    sets = sets.select("h1", "h2", F.col("least.doc_id").alias("node"), F.col("least.n_shingles").alias("size"), F.col("least.bins").alias("bins"))
    sets = written(sets, "sets")

    labels = texts = None
    nodes, first = sets, None
    for turn, (width, count) in enumerate(rounds):
        members = written(bucketed(nodes, turn, width, count), "buckets")
        edges = written(stars(members, labels), "stars")
        if texts is None:
            first = members
            # both sides grow with the input, so the join is by shuffle at every size
            wanted = members.select("node").distinct()
            texts = docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"].cast("string").alias("text"))
            texts = written(texts.join(wanted.hint("merge"), "node", "left_semi"), "candidate-texts")
        checked = written(confirmed(edges, texts), "links")
        labels = _joined(labels, checked.where("linked").select("a", "b"))
        again = written(residues(checked, labels, sets), "residues")
        if not again.isEmpty():
            further = written(agreeing(stars(again, labels), sets), "stars")
            labels = _joined(labels, written(confirmed(further, texts).where("linked").select("a", "b"), "links"))
        doubted = _several(_labelled(members, labels, "node")).select("node").distinct()
        nodes = written(sets.join(doubted.hint("merge"), "node", "left_semi").select("node", "size", "bins"), "doubted")
        if nodes.isEmpty():
            break
    if exhaustive and first is not None:
        labels = _each_a_hub(first, labels, texts)

    named = sets.select("h1", "h2", "node")
    named = _labelled(named, labels, "node").select("h1", "h2", F.col("node_comp").alias("comp")) if labels is not None else named.withColumnRenamed("node", "comp")
    joined = rows.drop("bins").join(named.hint("merge"), ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def _labelled(df: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``df`` with the component of its column ``node``; a node without links is its own."""
    found = labels.select(F.col("node").alias(node), F.col("comp").alias("__comp"))
    return df.join(found.hint("merge"), node, "left").withColumn(f"{node}_comp", F.coalesce("__comp", node)).drop("__comp")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links; only the new ones are worked on."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    between = _labelled(_labelled(links, labels, "a"), labels, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    new = components(between)
    moved = labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")).hint("merge"), "comp", "left")
    moved = moved.select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = new.join(labels.select("node").hint("merge"), "node", "left_anti")
    return written(moved.unionByName(fresh), "labels")


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    ends = members.groupBy("bucket").agg(F.min("node_comp").alias("low"), F.max("node_comp").alias("high")).where("low != high")
    return members.join(ends.select("bucket").hint("merge"), "bucket", "left_semi")


def _each_a_hub(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Components after each bucket has had all its members as hubs in turn, by node, as long as it holds several components."""
    seen = None
    while True:
        open_ = _several(_labelled(members, labels, "node"))
        if seen is not None:
            open_ = open_.join(seen.hint("merge"), "bucket").where(F.col("node") > F.col("b"))
        open_ = written(open_.select("bucket", "node", "size", "n", "node_comp"), "open")
        if open_.isEmpty():
            return labels
        hubs = open_.groupBy("bucket").agg(F.min(F.struct("node", "size", "node_comp")).alias("hub"))
        spokes = open_.join(hubs.hint("merge"), "bucket").where("node_comp != hub.node_comp")
        spokes = spokes.where(100 * F.least("size", "hub.size") >= PERCENT * F.greatest("size", "hub.size"))
        edges = spokes.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.max("n").alias("n"))
        edges = edges.select("a", "b", F.expr(f"pmod(xxhash64(a), 1 + n div {SPOKES})").alias("part"))
        labels = _joined(labels, written(confirmed(written(edges, "turns"), texts).where("linked").select("a", "b"), "links"))
        seen = hubs.select("bucket", F.col("hub.node").alias("b"))

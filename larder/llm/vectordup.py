"""Near copies among vectors: sign hashing by random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .graph import components
from .shared import written
from .words import mix64

#: Vectors are linked from this cosine on.
LEAST = 0.95
#: Tables are as many as let a pair at LEAST share no bucket with this chance at most; nearer pairs share more.
MISS = 1e-3
#: Vectors of a bucket, on average; the bits of a bucket's name follow from it.
CROWD = 128
#: Vectors of a side that meet in one task.
TILE = 1024
#: Vectors that stand for a bucket of more than TILE at first.
HUBS = 4
#: Tasks that a group's members are dealt to where they meet their group's row.
SALTS = 64
#: Parts of a component, of about TILE vectors, whose mean is its middle. Any middle gives right counts.
MIDDLE = 64
_PAIRS = "a long, b long"


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension, in doubles, of length one."""
    found = column.combine_chunks()
    wide = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(found), -1)
    wide = wide / np.abs(wide).max(axis=1, initial=0, keepdims=True)  # squares neither overflow nor vanish
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that connect whatever the links of the table connect, fewer than rows and columns."""
    rest_rows, rest_columns, out = linked.any(axis=1), linked.any(axis=0), []
    for root in np.flatnonzero(rest_rows).tolist():
        if not rest_rows[root]:
            continue
        rest_rows[root] = False
        rows = np.array([root])
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & rest_columns)
            out += zip(rows[linked[np.ix_(rows, columns)].argmax(axis=0)].tolist() if len(columns) else [], columns.tolist(), strict=True)
            rest_columns[columns] = False
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & rest_rows)
            out += zip(rows.tolist(), columns[linked[np.ix_(rows, columns)].argmax(axis=1)].tolist() if len(rows) else [], strict=True)
            rest_rows[rows] = False
    return out


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a tile, and where its few (role 0) and its many (role 1) are."""
    role = table["role"].to_numpy()
    return _units(table["vec"]), np.flatnonzero(role == 0), np.flatnonzero(role == 1)


def _tile_links(least: float):
    """The links (a, b) of a forest: few with many, or of a tile without few all with each other."""

    def run(table: pa.Table) -> pa.Table:
        units, few, many = _sides(table)
        few = few if len(few) else many
        linked = _linked(units[few], units[many], least)
        node = table["node"].to_numpy()
        linked &= node[few][:, None] != node[many][None, :]
        found = _forest(linked)
        ends = [[int(node[few[i]]) for i, _ in found], [int(node[many[j]]) for _, j in found]]
        return pa.table([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return run


def _tile_counts(least: float):
    """(node, key, n): for the few of a tile how many vectors the many that they link with stand for, for those
    of the many that are not few how many the few do; without few, all with each other."""

    def run(table: pa.Table) -> pa.Table:
        units, few, many = _sides(table)
        alone = not len(few)
        few = many if alone else few
        node, key, weight = (table[c].to_numpy() for c in ("node", "key", "weight"))
        linked = _linked(units[few], units[many], least)
        linked &= (node[few][:, None] != node[many][None, :]) | (key[few][:, None] != key[many][None, :])
        who, n = [few], [linked @ weight[many]]
        if not alone:
            core = table["core"].to_numpy(zero_copy_only=False)[many]
            who.append(many[core])
            n.append(linked[:, core].T @ weight[few])
        who, n = np.concatenate(who), np.concatenate(n).astype(np.int64)
        return pa.table([pa.array(node[who]), pa.array(key[who]), pa.array(n)], ["node", "key", "n"])

    return run


def tables_of(vectors: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's name and tables for so many vectors. Tables grow as about the sixth root of the vectors."""
    bits = max(1, math.ceil(math.log2(max(1, vectors) / CROWD)))
    shared = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - shared)))


def _bucketed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, key, bucket and n, the vectors of the bucket, of every bucket of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 2 ** np.arange(bits, dtype=np.uint64)
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                if d not in planes:
                    planes[d] = np.random.default_rng([d, bits]).standard_normal((d, bits * tables))
                for k in range(0, own.num_rows, 1024):
                    part = own.slice(k, 1024)
                    signs = (_units(pa.chunked_array([part.column(2)])) @ planes[d] > 0).reshape(-1, tables, bits)
                    codes = (signs * powers).sum(axis=2, dtype=np.uint64)
                    names = mix64(mix64(codes + np.uint64(1)) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d << 40))
                    each = [pa.array(np.repeat(part.column(i).to_numpy(), tables)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*each, pa.array(names.ravel().view(np.int64))], ["node", "key", "bucket"])

    found = nodes.select("node", "key", "vec").mapInArrow(run, "node long, key long, bucket long")
    many = found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(many.hint("merge"), "bucket")


def _with_vectors(members: DataFrame, nodes: DataFrame) -> DataFrame:
    return members.join(nodes.select("node", "key", "vec", "weight").hint("merge"), ["node", "key"])


def _parts(n: Column) -> Column:
    return F.ceil(n / TILE).cast("int")


def _part(n: Column) -> Column:
    """The part of a vector, of as many as TILE asks for."""
    return F.pmod(F.xxhash64("node", "key"), _parts(n)).cast("int")


def _of_group(members: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``members`` with the columns of their group; each row of ``groups`` is sent SALTS times, so a hot group is no single task."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [group, "salt"]).drop("salt")


def _rectangles(members: DataFrame, group: str) -> DataFrame:
    """Rows of tiles: the few of each group meet all its members, in parts of about TILE each. A vector is sent
    once for each part of the other side, so a group with few few is sent hardly more than once."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n_all"), F.count(F.when(F.col("few"), 1)).alias("n_few")).where("n_few > 0")
    sized = _of_group(members, sizes, group)
    many = sized.withColumns({"role": F.lit(1), "part_all": _part(F.col("n_all")), "part_few": F.explode(F.sequence(F.lit(0), _parts(F.col("n_few")) - 1))})
    few = sized.where("few").withColumns({"role": F.lit(0), "part_few": _part(F.col("n_few")), "part_all": F.explode(F.sequence(F.lit(0), _parts(F.col("n_all")) - 1))})
    return many.unionByName(few)


def _links(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """node and comp of all linked nodes, from the buckets' members.

    A bucket of TILE vectors or fewer is one task. Of a larger one all members meet its hubs first; then those outside its
    largest component meet all, so what a group of near copies costs grows with the group, not with its square.
    """
    small = _with_vectors(members.where(F.col("n") <= TILE), nodes).withColumn("role", F.lit(1))
    links = small.groupBy("bucket").applyInArrow(_tile_links(least), _PAIRS)
    large = written(members.where(F.col("n") > TILE), "vector-crowds")
    if large.isEmpty():
        return components(links)
    rows = large.withColumns({"role": F.lit(1), "part": _part(F.col("n"))})
    hubs = large.groupBy("bucket", "n").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "node", "key").alias("h"), "node", "key")).alias(f"hub{i}") for i in range(HUBS)])
    hubs = hubs.select("bucket", "n", F.explode(F.array_distinct(F.array(*[F.struct(f"hub{i}.node", f"hub{i}.key") for i in range(HUBS)]))).alias("hub"))
    hubs = hubs.select("bucket", "n", "hub.*", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part"))
    stars = _with_vectors(rows.unionByName(hubs), nodes).groupBy("bucket", "part").applyInArrow(_tile_links(least), _PAIRS)
    links = written(links.unionByName(stars), "vector-links")
    labels = components(links)
    placed = large.join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    largest = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size")).groupBy("bucket")
    largest = largest.agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    doubted = _of_group(placed, largest, "bucket").select("bucket", "node", "key", (F.col("comp") != F.col("top.comp")).alias("few"))
    tiles = _with_vectors(_rectangles(written(doubted, "vector-doubts"), "bucket"), nodes)
    further = tiles.groupBy("bucket", "part_few", "part_all").applyInArrow(_tile_links(least), _PAIRS)
    return components(links.unionByName(further))


def _counts(nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """node, key and n, how many vectors others than itself a linked node links with, counted within components.

    A component of TILE nodes or fewer is one task. In a larger one whatever lies within half the angle of a link from the
    middle is linked with its like, by the triangle's inequality, and is counted as one number. The others meet all.
    """
    sizes = nodes.select("node").join(labels.hint("merge"), "node").groupBy("comp").agg(F.count("*").alias("n"))
    placed = written(nodes.join(_of_group(labels, sizes, "comp").hint("merge"), "node"), "vector-components")
    small = placed.where(F.col("n") <= TILE).withColumn("role", F.lit(1))
    counts = small.groupBy("comp").applyInArrow(_tile_counts(least), "node long, key long, n long")
    large = placed.where(F.col("n") > TILE).withColumn("part", _part(F.col("n")))
    if large.isEmpty():
        return counts

    def total(table: pa.Table) -> pa.Table:
        sums = _units(table["vec"]).sum(axis=0)
        return pa.table([table["comp"].slice(0, 1), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["comp", "vec"])

    middles = large.where(F.col("part") < MIDDLE).groupBy("comp", "part").applyInArrow(total, "comp long, vec array<double>")
    middles = middles.groupBy("comp").applyInArrow(total, "comp long, vec array<double>")
    half = math.acos(least) / 2 - 1e-6

    def near(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        many = table.filter(pa.array(role == 1))
        middle = _units(table.filter(pa.array(role == 0))["vec"])
        core = np.arccos(np.clip(_units(many["vec"]) @ middle[0], -1, 1)) <= half if len(middle) else np.zeros(many.num_rows, bool)
        return many.select(["comp", "node", "key", "weight"]).append_column("core", pa.array(core))

    held = F.col("vec").cast("array<double>").alias("vec")
    spots = large.select("comp", "part", "node", "key", "weight", held, F.lit(1).alias("role"))
    asked = sizes.where(F.col("n") > TILE).select("comp", F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part"))
    asked = asked.join(middles.hint("merge"), "comp").select("comp", "part", *[F.lit(0).cast("long").alias(c) for c in ("node", "key", "weight")], "vec", F.lit(0).alias("role"))
    near_rows = spots.unionByName(asked).groupBy("comp", "part").applyInArrow(near, "comp long, node long, key long, weight long, core boolean")
    cores = written(near_rows, "vector-cores")
    inner = cores.where("core").groupBy("comp").agg(F.sum("weight").alias("inner"))
    of_core = _of_group(cores.where("core"), inner, "comp").select("node", "key", (F.col("inner") - F.col("weight")).alias("n"))
    tiles = _rectangles(cores.withColumn("few", ~F.col("core")), "comp").drop("weight")
    explicit = _with_vectors(tiles, nodes).groupBy("comp", "part_few", "part_all").applyInArrow(_tile_counts(least), "node long, key long, n long")
    return counts.unionByName(of_core).unionByName(explicit).groupBy("node", "key").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Vectors with a cosine, in doubles, of ``least`` or more are linked. Equal vectors become one node that stands for
    them (pre-aggregated). In each of several tables a vector's bucket is named by the sides of random hyperplanes that it lies on;
    a linked pair shares no bucket of any table with a chance of ``miss`` at most. Pairs of a bucket are checked in blocks, and only as many links
    leave a block as connect it, never all pairs. Components come of those; links are then counted
    within each component, whatever bucket they came from.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those of different
    dimensions with each other: n_links 0, component_id the vec_id. A null vec_id links with nothing and is kept, with component_id null. Repeated
    rows are one vector and get equal results; rows of one vec_id with different vectors are different vectors of one
    component. Other columns are not read. No rows give no rows.
    """
    vec = F.col("embedding")
    ok = F.coalesce(usable(vec) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), ok.alias("ok"), F.xxhash64(F.lit(1), vec).alias("key"), F.xxhash64(F.lit(2), vec).alias("key2"))
    nodes = rows.where("ok").groupBy("key", "key2").agg(F.min(F.struct("vec_id", "vec")).alias("least"), F.count_distinct("vec_id").alias("weight"))
    nodes = written(nodes.select(F.col("least.vec_id").alias("node"), "key", "key2", "weight", F.col("least.vec").alias("vec")), "vector-nodes")
    members = written(_bucketed(nodes, *tables_of(nodes.count(), least, miss)), "vector-buckets")
    labels = _links(members, nodes, least)
    counts = _counts(nodes, labels, least)
    found = nodes.select("node", "key", "key2", "weight").join(labels.hint("merge"), "node", "left").join(counts.hint("merge"), ["node", "key"], "left")
    found = found.select("key", "key2", F.coalesce("comp", "node").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = rows.drop("vec").join(found.hint("merge"), ["key", "key2"], "left")
    component = F.when(F.col("ok"), F.col("comp")).otherwise(F.col("vec_id"))
    links = F.when(F.col("ok"), F.col("n_links")).otherwise(0).cast("long")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

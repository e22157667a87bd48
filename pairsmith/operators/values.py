"""Grouping of interchangeable values (A14, V3-V14) over pair and edge tables."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairsmith.functions import similarity
from pairsmith.operators import tables

PAIR = ["ltable_id", "rtable_id"]


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the context's, or the session's spark.checkpoint.dir. Where neither is set, a temporary one
    serves a local master, whose tasks all see it; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Edges that one task joins into components, at most.
IN_ONE = 1 << 19


def components(edges: DataFrame, in_one: int = IN_ONE) -> DataFrame:
    """Node and component (its smallest node) for the nodes of edges (src, dst).

    While there are more than in_one edges, every node gives way to the first of itself and its neighbours in the order of
    a hash that changes with the round, which leaves a share of the nodes however they lie; one task joins what is left."""
    ends = cut(edges.select("src", "dst").distinct())
    left, given = ends.where("src <> dst"), []
    while left.limit(in_one + 1).count() > in_one:
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = lambda c, k=len(given): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("c"))
        to = cut(both.groupBy("src").agg(F.least(F.min(first("dst")), F.first(first("src"))).alias("x")).select(F.col("src").alias("node"), "x.c"))
        given.append(to)
        for c in ("src", "dst"):
            left = left.join(to.withColumnsRenamed({"node": c, "c": "_to"}), c).withColumn(c, F.col("_to")).drop("_to")
        left = cut(left.where("src <> dst").distinct())
    kind = ends.schema["src"].dataType.simpleString()
    part = left.coalesce(1).mapInArrow(_joined, f"node {kind}, c {kind}")
    for to in reversed(given):
        on = part.select(F.col("node").alias("c"), F.col("c").alias("_root"))
        part = to.join(on, "c", "left").select("node", F.coalesce("_root", "c").alias("c"))
    nodes = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
    part = cut(nodes.join(part, "node", "left").select("node", F.coalesce("c", "node").alias("c")))
    return part.join(part.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and c, a node of its component, for the nodes of edges (src, dst)."""
    parent, kind = {}, None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        kind = batch.schema.field("src").type
        for x, y in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "c"])


def banded_pairs(vectors: DataFrame, bits: int, bands: int = 2, key: str = "value", vec: str = "vec", within: str | None = None) -> DataFrame:
    """Candidate pairs (l, r) of vectors, l < r, for V3 to V12: those whose components have the same signs throughout one of
    several bands of ``bits`` components, 16 apart. A band halves what a vector meets with every bit, so that bits of
    log2(rows) less a constant keep candidates in proportion to rows. within: a column that both must share."""
    signs = F.array_join(F.transform(vec, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = vectors.select(F.col(key).alias("k"), (F.col(within) if within else F.lit(0)).alias("w"), signs.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    rows = rows.select("k", "w", "band", F.substr("s", F.col("band") * 16 + 1, F.lit(bits)).alias("s"))
    return rows.withColumnRenamed("k", "l").join(rows.withColumnRenamed("k", "r"), ["w", "band", "s"]).where("l < r").select("l", "r").distinct()


def semantic_edges(pairs: DataFrame, vectors: DataFrame, tau: float, words: bool = False, key: str = "value", vec: str = "vec") -> DataFrame:
    """V3, V5, V6: src < dst and sim of candidate pairs (l, r) whose vectors reach tau by cosine (or, for lists of word
    vectors, by the coherent factor)."""
    sim = similarity.coherent_factor if words else similarity.vector_cosine
    v = vectors.select(key, vec)
    both = pairs.select("l", "r").where("l <> r").join(v.select(F.col(key).alias("l"), F.col(vec).alias("_a")), "l").join(v.select(F.col(key).alias("r"), F.col(vec).alias("_b")), "r")
    both = both.withColumn("sim", sim(F.col("_a"), F.col("_b"))).where(F.col("sim") >= tau)
    return both.select(F.least("l", "r").alias("src"), F.greatest("l", "r").alias("dst"), "sim").dropDuplicates(["src", "dst"])


def groups(edges: DataFrame) -> DataFrame:
    """V4: value and group_id (the smallest value) of the components of edges (src, dst)."""
    return components(edges).select(F.col("node").alias("value"), F.col("component").alias("group_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def two_hop(edges: DataFrame, vectors: DataFrame, tau: float, key: str = "value", vec: str = "vec") -> DataFrame:
    """V7: the edges (src < dst), and pairs with a common neighbour and a cosine of tau or more. Pure two hops: edges
    added do not count as neighbours."""
    e = both_ways(edges)
    near = e.select(F.col("src").alias("l"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("r")), "m").where("l < r").select("l", "r").distinct()
    old = e.where("src < dst")
    fresh = near.join(old.select(F.col("src").alias("l"), F.col("dst").alias("r")), ["l", "r"], "left_anti")
    return old.unionByName(semantic_edges(fresh, vectors, tau, key=key, vec=vec).select("src", "dst"))


def best_neighbour(asked: DataFrame, edges: DataFrame, vectors: DataFrame, key: str = "value", vec: str = "vec") -> DataFrame:
    """V8: for rows (value, target), best: the neighbour of value most similar to target, and its sim, if positive."""
    v = vectors.select(key, vec)
    rows = asked.join(both_ways(edges).select(F.col("src").alias("value"), F.col("dst").alias("best")), "value")
    rows = rows.join(v.select(F.col(key).alias("best"), F.col(vec).alias("_a")), "best").join(v.select(F.col(key).alias("target"), F.col(vec).alias("_b")), "target")
    rows = rows.withColumn("sim", similarity.vector_cosine(F.col("_a"), F.col("_b"))).where("sim > 0")
    return rows.groupBy("value", "target").agg(F.min_by(F.struct("best", "sim"), F.struct(-F.col("sim"), F.col("best"))).alias("x")).select("value", "target", "x.best", "x.sim")


def normalise_values(df: DataFrame, attr: str, grouped: DataFrame) -> DataFrame:
    """V9: values of a group with several members become the group's smallest value."""
    first = grouped.groupBy("group_id").agg(F.min("value").alias("first"), F.countDistinct("value").alias("n")).where("n > 1")
    to = grouped.join(first, "group_id").select(F.col("value").alias(attr), "first").distinct()
    return df.join(to, attr, "left").withColumn(attr, F.coalesce("first", attr)).select(*df.columns)


#: Buckets of left values at least, vectors a bucket beyond that, value pairs of one group of left values in one part, and parts of a group at most.
BUCKETS, BUCKET_VECTORS, PART_PAIRS, PARTS = 64, 1 << 12, 1 << 16, 16
#: Similarities held at a time.
HELD = 1 << 22


def rewrite_negatives(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, attr: str, key: str = "value", vec: str = "vec") -> DataFrame:
    """In rejected pairs, values with neighbours give way to the neighbour most similar to the other side; if both
    sides have some, to the best pair of neighbours (of pairs alike to 12 decimals the smallest).

    Neighbours of both sides are not multiplied out into rows. Left values go to buckets by the least hash among themselves
    and their neighbours, which those of a dense group share; a bucket gets its value pairs, their lists of neighbours and
    each vector once, and compares what a group of left values shares once."""
    l, r = f"ltable_{attr}", f"rtable_{attr}"
    near = cut(both_ways(edges))
    kind = near.schema["src"].dataType
    lists = near.groupBy("src").agg(F.collect_list("dst").alias("near"), F.least(F.min(F.xxhash64("dst")), F.xxhash64("src")).alias("g"))
    asked = cut(pairs.select(F.col(l).cast(kind).alias("x"), F.col(r).cast(kind).alias("y")).distinct())
    left = asked.groupBy("x").agg(F.count("*").alias("n"))
    left = left.join(lists.select("src", "g"), F.col("x") == F.col("src"), "left").select("x", "n", F.coalesce("g", F.xxhash64("x")).alias("g"))
    parts = left.groupBy("g").agg(F.least(F.lit(PARTS), F.ceil(F.sum("n") / PART_PAIRS)).alias("parts"))
    buckets = max(BUCKETS, math.ceil(vectors.count() / BUCKET_VECTORS))
    left = left.join(parts, "g").select("x", "g", F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("x"), F.col("parts"))), F.lit(buckets)).alias("bucket"))
    asked = cut(asked.join(left.withColumnRenamed("x", "_x"), F.col("x").eqNullSafe(F.col("_x"))).select("bucket", "g", "x", "y"))
    ends = asked.select("bucket", "x").union(asked.select("bucket", "y")).distinct()
    ends = cut(ends.join(lists.drop("g"), F.col("x") == F.col("src"), "left").select("bucket", "x", F.coalesce("near", F.array("x")).alias("near")))
    v = vectors.select(F.col(key).alias("_v"), F.col(vec).alias("vec"))
    held = ends.select("bucket", F.explode("near").alias("x")).distinct().join(v, F.col("x") == F.col("_v")).select("bucket", "x", "vec")
    rows = asked.unionByName(ends, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
    out = StructType([StructField(c, kind) for c in ("_x", "_y", "_nl", "_nr")])
    best = rows.groupBy("bucket").applyInArrow(_best_pairs, out)
    found = pairs.join(best, F.col(l).eqNullSafe(F.col("_x")) & F.col(r).eqNullSafe(F.col("_y")))
    return found.withColumns({l: F.col("_nl"), r: F.col("_nr")}).select(*pairs.columns)


def _best_pairs(table: pa.Table) -> pa.Table:
    """The best pair of neighbours for each value pair of a bucket: rows with y are value pairs, with near neighbours (a
    value's own if it has none), with vec vectors."""
    g, near, vec = (table[c].combine_chunks() for c in ("g", "near", "vec"))
    is_pair, is_list, is_vec = (np.asarray(c.is_valid()) for c in (g, near, vec))
    x = table["x"].combine_chunks()
    lists, vecs = near.drop_null(), vec.drop_null()
    coded = pa.concat_arrays([x, table["y"].combine_chunks().filter(pa.array(is_pair)), lists.flatten()]).dictionary_encode("encode")
    names = coded.dictionary
    order = np.asarray(pc.array_sort_indices(names, null_placement="at_start"))
    names = names.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[np.asarray(coded.indices)]
    x, right, flat = np.split(codes, [len(table), len(table) + is_pair.sum()])
    cosines = _cosines(x[is_vec], vecs, len(names))

    size = np.asarray(lists.value_lengths())
    start, place = np.cumsum(size) - size, np.zeros(len(names), np.int64)
    place[x[is_list]] = np.arange(len(size))
    left, g = x[is_pair], np.asarray(g.drop_null())
    by = np.lexsort((right, left, g))
    left, right, g = left[by], right[by], g[by]
    new_g = np.r_[True, g[1:] != g[:-1]]
    firsts = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | new_g[1:], True])
    groups = np.flatnonzero(np.r_[new_g[firsts[:-1]], True])
    got_l, got_r = np.empty_like(left), np.empty_like(right)

    def neighbours(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of several values in one row, and where each value's begin."""
        at, n = start[place[of]], size[place[of]]
        begin = np.cumsum(n) - n
        return flat[np.arange(n.sum()) + np.repeat(at - begin, n)], begin

    for a, b in zip(groups[:-1], groups[1:], strict=True):
        runs = list(zip(firsts[a:b], firsts[a + 1 : b + 1], strict=True))
        sides = [np.sort(neighbours(left[i : i + 1])[0]) for i, _ in runs]
        shared = None
        if len(runs) > 1:
            rows, cols = np.unique(np.concatenate(sides)), np.unique(neighbours(np.unique(right[firsts[a] : firsts[b]]))[0])
            each = sum(len(side) * min(len(cols), size[place[right[i:j]]].sum()) for side, (i, j) in zip(sides, runs, strict=True))
            if len(rows) * len(cols) <= min(each, 4 * HELD):
                shared = cosines(rows, cols)
        for side, (i, j) in zip(sides, runs, strict=True):
            there, begin = neighbours(right[i:j])
            if shared is not None and len(there) >= len(cols):
                mine, at, own = cols, np.searchsorted(cols, there), shared[np.searchsorted(rows, side)]
            else:
                mine, at = np.unique(there, return_inverse=True)
                own = None if shared is None else shared[np.ix_(np.searchsorted(rows, side), np.searchsorted(cols, mine))]
            best, by = np.empty(len(mine)), np.empty(len(mine), np.int64)
            step = max(1, HELD // len(side))
            for k in range(0, len(mine), step):
                s = cosines(side, mine[k : k + step]) if own is None else own[:, k : k + step]
                top = s.argmax(0)
                best[k : k + step], by[k : k + step] = s[top, np.arange(len(top))], side[top]
            order = np.lexsort((mine, by, -best))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            first = order[np.minimum.reduceat(rank[at], begin)]
            got_l[i:j], got_r[i:j] = by[first], mine[first]
    return pa.table({c: names.take(pa.array(k)) for c, k in (("_x", left), ("_y", right), ("_nl", got_l), ("_nr", got_r))})


def _cosines(at: np.ndarray, vecs: pa.ListArray, n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cosines of values, by their codes, to 12 decimals: -2 without one (no vector, a null in it, other lengths, zero), and
    less for no number. The same vectors give the same cosine wherever they stand."""
    flat, lens = vecs.flatten(), np.asarray(vecs.value_lengths())
    row, col = np.repeat(at, lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    held, dims = np.zeros((n, max(lens, default=0))), np.full(n, -1)
    held[row, col] = np.asarray(flat.cast("double").fill_null(0.0))
    dims[at] = lens
    dims[row[np.asarray(flat.is_null())]] = -1
    norm = np.sqrt(np.einsum("ik,ik->i", held, held))

    def run(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            both = norm[rows, None] * norm[cols]
            s = np.round(np.einsum("ik,jk->ij", held[rows], held[cols]) / both, 12)
        s[np.isnan(s)] = -3.0
        s[(both == 0) | (dims[rows, None] != dims[cols]) | (dims[rows, None] < 0)] = -2.0
        return s

    return run


def two_way_slim(pairs: DataFrame, score: str = "score") -> DataFrame:
    """The best right id of each left id, then of what is left the best left id of each right id."""
    first = tables.slim(pairs, "ltable_id", "rtable_id", score)
    return tables.slim(first, "rtable_id", "ltable_id", score).select(*PAIR, score)


def two_way_nearest(pairs: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best right ids of each left id, then the k best left ids of each right id."""
    return tables.nearest(tables.nearest(pairs, "ltable_id", k, "rtable_id", score), "rtable_id", k, "ltable_id", score)


def expansion_check(negatives: DataFrame, grouped: DataFrame, gold: DataFrame, attr: str) -> DataFrame:
    """How many rejected pairs have both values in one group, and how many of those are gold."""
    g = grouped.select("value", "group_id")
    rows = negatives.join(g.select(F.col("value").alias(f"ltable_{attr}"), F.col("group_id").alias("_gl")), f"ltable_{attr}").join(g.select(F.col("value").alias(f"rtable_{attr}"), F.col("group_id").alias("_gr")), f"rtable_{attr}").where("_gl = _gr")
    hits = rows.join(gold.select(F.col("id1").alias("ltable_id"), F.col("id2").alias("rtable_id"), F.lit(1).alias("_g")), PAIR, "left")
    return hits.agg(F.count("*").alias("n_linked"), F.count("_g").alias("n_gold"))


def restore(pairs: DataFrame, a: DataFrame, b: DataFrame, attr: str) -> DataFrame:
    """The original values of a pair table, by id."""
    out = pairs.drop(f"ltable_{attr}", f"rtable_{attr}")
    return out.join(a.select(F.col("_id").alias("ltable_id"), F.col(attr).alias(f"ltable_{attr}")), "ltable_id").join(b.select(F.col("_id").alias("rtable_id"), F.col(attr).alias(f"rtable_{attr}")), "rtable_id")

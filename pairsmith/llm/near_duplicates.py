"""Exact n-gram Jaccard join over groups of similar documents.

Equal shingle sets are one node. Nodes sort their shingles by rarity; two nodes can only be similar if their prefixes
share a shingle (prefix filter), so only those meet. First each node is tried against one leader, the node that holds a
shared shingle earliest: verified links make groups of similar documents. Then groups, not documents, are joined. A
group of several nodes is a row of the token-group matrix: the union of its members' shingles. A query node's overlap
with the union bounds its overlap with every member; only groups that reach the bound are opened, and their members
are compared one by one (by parity bits, an exact bound on the difference, then by the sets). Components of all
verified links are the result; pairs within a group are never listed.

Candidates and bounds go by 64-bit fingerprints of shingles; the last comparison of two sets, which alone makes a link,
goes by 128 bits a shingle. Sets count as equal if the 64-bit digests of their fingerprints are: among 10^10 different
sets that is expected to go wrong for about three pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm.base import cut, hidden, mapped, slices, table
from pairsmith.llm.shingles import differing_bits, parity_bits, set_id, shared, shingle_sets

#: Slots known to hold frequent shingles, at most: the size of the one table that is broadcast. Order alone depends on
#: it; the result does not.
FREQUENT = 1 << 20
#: Shingles are counted in 2^32 slots by the upper half of their hash, slots in ranges of 2^20, over windows of so many
#: hashes; from OVERALL occurrences on a slot is frequent.
RANGES, WINDOW, OVERALL = 1 << 12, 1 << 21, 8
#: Ids of documents whose sets are fetched by a broadcast list; beyond, by a join.
LISTED = 1 << 21
#: Members and queries that are compared at a time when a group is opened.
OPENED = 1024


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent slots, sorted, and their counts over all documents.

    Each window of hashes is sorted and sent as differences of two bytes, a blob a range; a range is counted in one
    array of fixed size while its blobs stream by."""
    span = (1 << 32) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held))
            cuts = np.searchsorted(slots, np.arange(RANGES + 1, dtype=np.uint64) * span)
            own = np.flatnonzero(np.diff(cuts))
            blobs = []
            for r in own.tolist():
                steps = np.diff(slots[cuts[r] : cuts[r + 1]], prepend=np.uint32(r * span))
                blobs.append(b"2" + steps.astype(np.uint16).tobytes() if steps.max() < 1 << 16 else b"4" + steps.tobytes())
            return pa.record_batch([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["r", "steps"])

        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                for h in shingle_sets(part.column("_text").cast(pa.binary()).to_pylist(), width):
                    held.append((h >> np.uint64(32)).astype(np.uint32))
                    size += len(h)
                if size >= WINDOW:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = -1, np.zeros(span, np.int64)

        def done() -> pa.RecordBatch:
            own = np.flatnonzero(counts >= OVERALL)
            return pa.record_batch([pa.array(own + now * span, pa.int64()), pa.array(counts[own])], ["h", "n"])

        for batch in batches:
            for r, blob in zip(batch.column("r").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                if r != now:
                    if now >= 0:
                        yield done()
                    now = r
                    counts[:] = 0
                at = np.cumsum(np.frombuffer(blob, np.uint16 if blob[:1] == b"2" else np.uint32, offset=1), dtype=np.int64)
                np.add.at(counts, at, 1)
        if now >= 0:
            yield done()

    got = cut(docs.select("_text").transform(mapped, run, "r int, steps binary").repartition("r").sortWithinPartitions("r").transform(mapped, count, "h long, n long"))
    # the largest counts that are FREQUENT together: by steps of a quarter power of two, so that no task sorts for the rest
    step, held, least = F.floor(F.log2("n") * 4), 0, 0
    for r in got.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 160 rows at most
        if (held := held + r["count"]) > FREQUENT:
            least = r.step + 1
            break
    got = got.where(step >= least).toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order].astype(np.uint32), n[order].astype(np.int32)


def _sketches(docs: DataFrame, frequent, width: int, least: int, of: int) -> DataFrame:
    """key, node (id of the shingle set; null if empty), n (its size), prefix (rarest shingles first), rare (how many of
    them are not known to be frequent) and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                nodes, sizes, prefixes, rare, bits = [], [], [], [], []
                for h in shingle_sets(part.column("_text").cast(pa.binary()).to_pylist(), width):
                    n = len(h)
                    sizes.append(n)
                    if not n:
                        for x in (nodes, prefixes, rare, bits):
                            x.append(None)
                        continue
                    nodes.append(set_id(h))
                    often = np.zeros(n, np.int64)
                    if len(known):
                        slot = (h >> np.uint64(32)).astype(np.uint32)
                        at = np.minimum(np.searchsorted(known, slot), len(known) - 1)
                        often = np.where(known[at] == slot, counts[at], 0)
                    own = np.lexsort((h, often))[: n - -(-least * n // of) + 1]
                    prefixes.append(h[own].view(np.int64))
                    rare.append(int((often[own] == 0).sum()))
                    bits.append(parity_bits(h))
                yield pa.record_batch([part.column("_key"), part.column("_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(bits, pa.binary())], ["_key", "_id", "node", "n", "prefix", "rare", "bits"])

    return docs.transform(mapped, run, "_key long, _id long, node long, n int, prefix array<long>, rare int, bits binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n and set (its sorted shingles, two fingerprints of eight bytes each) of the nodes in wanted (_key of one of its
    documents, node)."""
    spark = docs.sparkSession
    few = wanted.limit(LISTED + 1).count() <= LISTED
    if few:
        got = wanted.select("_key", "node").toArrow()
        keys = got.column("_key").combine_chunks().fill_null(-(1 << 63)).to_numpy()
        order = np.argsort(keys)
        listed = spark.sparkContext.broadcast((keys[order], np.sort(got.column("node").to_numpy())))
    else:
        docs = docs.join(wanted.select("_key").distinct(), docs["_key"].eqNullSafe(wanted["_key"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if few:
                keys, nodes = listed.value
                own = batch.column("_key").fill_null(-(1 << 63)).to_numpy()
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                batch = batch.filter(pa.array(keys[at] == own if len(keys) else np.zeros(len(own), bool)))
            for part in slices(batch, "_text", 1 << 19):
                sets = [h for h in shingle_sets(part.column("_text").cast(pa.binary()).to_pylist(), width, 2) if len(h)]
                ids = [set_id(np.unique(h[:, 0])) for h in sets]
                if few and sets:
                    at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
                    there = nodes[at] == np.array(ids)
                    ids, sets = [x for x, ok in zip(ids, there, strict=True) if ok], [x for x, ok in zip(sets, there, strict=True) if ok]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "n", "set"])

    out = docs.transform(mapped, run, "node long, n int, set binary")
    if not few:
        out = out.join(wanted.select("node").distinct(), "node", "left_semi")
    return out.dropDuplicates(["node"])


def _alike(pairs: DataFrame, least: int, of: int, exact: bool) -> DataFrame:
    """The pairs (a, b) whose sets link (exact), or whose bits leave that open; pairs has x, y (bits or sets), na, nb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y, m, n in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), part.column("na").to_pylist(), part.column("nb").to_pylist(), strict=True):
                    both = shared(np.frombuffer(x, np.uint64).reshape(-1, 2), np.frombuffer(y, np.uint64).reshape(-1, 2)) if exact else (m + n - differing_bits(x, y)) // 2
                    keep.append(of * both >= least * (m + n - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y", "na", "nb").transform(mapped, run, "a long, b long")


def _opened(asking: DataFrame, members: DataFrame, bits: DataFrame, least: int, of: int) -> DataFrame:
    """Pairs (a, b) of an asking node and a member of the group g it asks whose sizes and bits allow a link. Both sides
    come in blocks of about OPENED rows by hash, so that no group is too large for a task; only what may link leaves it."""
    own = asking.select("node").union(members.select("node")).distinct()
    own = cut(bits.join(own, "node", "left_semi").dropDuplicates(["node"]))
    blocks = asking.groupBy("g").agg(F.ceil(F.count("*") / OPENED).alias("qs")).join(members.groupBy("g").agg(F.ceil(F.count("*") / OPENED).alias("ms")), "g")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = asking.join(own, "node").join(blocks, "g").select("g", "node", "n", "bits", block("qs").alias("qb"), every("ms").alias("mb"))
    m = members.join(own, "node").join(blocks, "g").select(F.col("g").alias("mg"), F.col("node").alias("mnode"), F.col("n").alias("mn"), F.col("bits").alias("mbits"), every("qs").alias("mqb"), block("ms").alias("mmb"))

    def compare(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        found = {"a": [], "b": []}
        classes = []
        for size, part in ms.groupby(ms["mbits"].map(len)):
            classes.append((size, part["mnode"].to_numpy(), part["mn"].to_numpy().astype(np.int64), np.frombuffer(b"".join(part["mbits"]), np.uint8).reshape(len(part), size)))
        for node, n, raw in zip(qs["node"], qs["n"], qs["bits"], strict=True):
            for size, nodes, ns, rows in classes:
                x = np.frombuffer(raw, np.uint8)
                while len(x) > size:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while rows.shape[1] > len(x):
                    rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
                both = (n + ns - np.bitwise_count(rows ^ x).sum(1, dtype=np.int64)) // 2
                ok = (of * both >= least * (n + ns - both)) & (nodes != node)
                found["b"] += nodes[ok].tolist()
                found["a"] += [node] * int(ok.sum())
        return pd.DataFrame(found, dtype="int64")

    return q.groupBy("g", "qb", "mb").cogroup(m.groupBy("mg", "mqb", "mmb")).applyInPandas(compare, "a long, b long")


def _with(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value and size of both nodes."""
    left = side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(value).alias("x"))
    right = side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of edges (a, b).

    Labels spread along edges and jump to their label's label, so that the rounds grow with the logarithm of the
    longest path; every round is checkpointed."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = cut(step.join(jump, "root").select("node", F.least("root", "over").alias("root"), "was"))
        if not new.where("root <> was").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, least: int = 75, of: int = 100) -> DataFrame:
    """key, n_shingles, component_id, text_hash (xxhash64 of the text) and component (a number for it; null if empty) for
    every row of df.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a row's set holds its distinct shingles of
    ``width`` words (all its words as one, if they are fewer). Rows link when of * |intersection| >= least * |union|;
    component_id is the smallest key among the rows that links reach. Rows without words (null and empty texts) have
    n_shingles 0 and link with nothing: component_id is their own key. Repeated rows, and rows with equal sets, share a
    component; an empty table gives an empty one; rows with one key but different texts are linked only by their texts; a null key never becomes an id
    unless all keys of the component are null. Other columns are not read.

    The prefix rows of rare shingles are shuffled once; leaders of frequent ones are aggregated before the shuffle, and
    their join is one that Spark splits where a shingle is hot. Groups are joined by shared prefix shingles, never all
    with all; an opened group is compared in blocks."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_id"), F.col(text).alias("_text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))
    base = cut(_sketches(docs, frequent, width, least, of))
    keys = base.where("n > 0").groupBy("node").agg(F.min("_key").alias("_key"))

    # nodes that share a prefix shingle with another node
    rows = base.where("n > 0").select("node", "n", "rare", F.posexplode("prefix").alias("pos", "tok"))
    lead = (F.min(F.struct("pos", "n", "node")).alias("lead"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    rare = rows.where("pos < rare").select("tok", "node", "n", "pos").repartition("tok")
    often = rows.where("pos >= rare").select("tok", "node", "n", "pos")
    shared = rare.join(rare.groupBy("tok").agg(*lead).where("lo < hi").select("tok", "lead"), "tok")
    shared = shared.unionByName(often.join(often.groupBy("tok").agg(*lead).where("lo < hi").select("tok", "lead"), "tok"))
    shared = cut(shared.groupBy("tok", "node", "n", "pos").agg(F.first("lead").alias("lead")))

    def may(n1: str, n2: str, p1: str, p2: str) -> F.Column:
        """Length bound, and positional bound for a pair whose first shared shingle stands at these positions."""
        need = f"ceil({least} * (cast({n1} as long) + {n2}) / {least + of})"
        return F.expr(f"{of} * cast(least({n1}, {n2}) as long) >= {least} * greatest({n1}, {n2}) and 1 + least({n1} - {p1}, {n2} - {p2}) - 1 >= {need}")

    # groups: each node and the leader with which it shares most
    tried = shared.where("lead.node <> node").where(may("n", "lead.n", "pos", "lead.pos")).groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).count()
    tried = tried.groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    bits = base.where("n > 0").select("node", "n", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        own = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        left = cut(_alike(_with(pairs, cut(bits.join(own, "node", "left_semi").dropDuplicates(["node"])), "bits"), least, of, False))
        own = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        return cut(_alike(_with(left, cut(_sets(docs, keys.join(own, "node", "left_semi"), width)), "set"), least, of, True))

    links = verified(tried)
    group = components(links)

    # groups that share a prefix shingle
    mine = shared.join(group, "node", "left").select("tok", "node", "n", "pos", F.coalesce("root", "node").alias("g"))
    held = mine.groupBy("tok", "g").agg(F.min("n").alias("mn"), F.max("n").alias("mx"), F.min("pos").alias("pos"))
    a, b = (held.select("tok", *(F.col(c).alias(f"{c}_{s}") for c in ("g", "mn", "mx", "pos"))) for s in "ab")
    need = f"ceil({least} * (cast(mn_a as long) + mn_b) / {least + of})"
    fits = f"g_a < g_b and {of} * cast(mx_a as long) >= {least} * mn_b and {of} * cast(mx_b as long) >= {least} * mn_a and least(mx_a - pos_a, mx_b - pos_b) >= {need}"
    met = cut(a.join(b, "tok").where(fits).select("g_a", "g_b").distinct())

    # the token-group matrix bounds a node's overlap with a group of several nodes
    size = group.groupBy(F.col("root").alias("g")).agg(F.count("*").alias("members"))
    sized = met.join(size.select(F.col("g").alias("g_a"), F.col("members").alias("m_a")), "g_a", "left").join(size.select(F.col("g").alias("g_b"), F.col("members").alias("m_b")), "g_b", "left").na.fill(1, ["m_a", "m_b"])
    single = sized.where("m_a = 1 and m_b = 1").select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))
    asks = F.col("m_a") <= F.col("m_b")
    several = cut(sized.where("m_a > 1 or m_b > 1").select(F.when(asks, F.col("g_a")).otherwise(F.col("g_b")).alias("q"), F.when(asks, F.col("g_b")).otherwise(F.col("g_a")).alias("g")))
    pairs = single
    if several.limit(1).count():
        ends = several.select(F.col("q").alias("root")).union(several.select("g")).distinct()
        members = cut(ends.join(group, "root", "left").select("root", F.coalesce("node", "root").alias("node")))
        sets = cut(_sets(docs, keys.join(members.select("node").distinct(), "node", "left_semi"), width).join(members, "node"))
        hashes = _unpacked(sets)
        matrix = hashes.select("root", "h").distinct()
        least_n = sets.groupBy("root").agg(F.min("n").alias("mn"))
        asked = several.join(sets.select(F.col("root").alias("q"), "node"), "q").select("g", "node")
        hit = asked.join(hashes.select("node", "n", "h"), "node").join(matrix.select(F.col("root").alias("g"), "h"), ["g", "h"]).groupBy("g", "node", "n").count()
        opened = hit.join(least_n.withColumnRenamed("root", "g"), "g").where(f"count >= ceil({least} * (cast(n as long) + mn) / {least + of})")
        close = cut(_opened(opened.select("g", "node"), sets.select(F.col("root").alias("g"), "node"), bits, least, of))
        pairs = pairs.unionByName(close)
    links = links.unionByName(verified(pairs))

    root = components(links)
    smallest = keys.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "_key")
    smallest = smallest.join(smallest.groupBy("root").agg(F.min("_key").alias("component_id")), "root").select("node", "root", "component_id")
    out = base.select("_key", "_id", "node", "n").join(smallest, "node", "left")
    return out.select(F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"), F.col("_id").alias("text_hash"), F.col("root").alias("component"))


def _unpacked(sets: DataFrame) -> DataFrame:
    """One row a hash of each set: root, node, n, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                h = [np.frombuffer(x, np.int64)[::2] for x in part.column("set").to_pylist()]
                n = list(map(len, h))
                yield pa.record_batch([*(pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("root", "node", "n")), pa.array(np.concatenate(h))], ["root", "node", "n", "h"])

    return sets.select("root", "node", "n", "set").transform(mapped, run, "root long, node long, n int, h long")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df with the smallest key (then text hash) of their component, and all without words; of rows that
    are equal in key and text one stays. All columns pass unchanged, whatever their names.

    Only rows that are not alone with their key and text are shuffled with their texts once more to choose one of them."""
    df, own = hidden(df, "text_hash", "component", "component_id", "n_shingles")
    text, key = ({c: new for new, c in own.items()}.get(x, x) for x in (text, key))
    found = near_duplicates(df, text, key).groupBy(key, "text_hash", "component").agg(F.count("*").alias("n"))
    found = cut(found)
    words = found.where("component is not null").groupBy("component").agg(F.min(F.struct(key, "text_hash", "n")).alias("k")).select(F.col(f"k.{key}").alias("_k"), F.col("k.text_hash").alias("_h"), F.col("k.n").alias("_n"))
    stay = cut(words.unionByName(found.where("component is null").select(F.col(key).alias("_k"), F.col("text_hash").alias("_h"), F.col("n").alias("_n"))))
    rows = df.withColumn("_text_hash", F.xxhash64(text))

    def staying(which: str) -> DataFrame:
        return rows.join(stay.where(which), F.col(key).cast("long").eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_h")), "left_semi")

    return staying("_n = 1").unionByName(staying("_n > 1").dropDuplicates([key, "_text_hash"])).drop("_text_hash").withColumnsRenamed(own)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLE_SQL = {
    "op4_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM d, range(1, greatest(1, len(w) - 4) + 1) t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(r, other) AS (SELECT r, r FROM d UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other)
SELECT any_value(d.doc_id) AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d o ON o.r = reach.other LEFT JOIN n ON n.r = d.r GROUP BY d.r"""
}

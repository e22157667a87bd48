"""Approximate maximum inner product search with score-aware quantisation.

Vectors are coded in subspaces of two dimensions with 16 centres each, four bits a subspace. Codes and codebooks
minimise an anisotropic loss: the part of a residual parallel to its vector, which moves large inner products, costs
``eta`` times what the orthogonal part costs. A query scans the codes of a block with lookup tables, two subspaces a
lookup; the best of the block are scored exactly, and the best of all blocks are the result. Equal vectors of a block
are scanned once and give their rows in order of id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsmith.llm.base import cut, mapped, table

CENTRES, WIDTH = 16, 2
#: Rows from which codebooks are fitted at most; all rows are coded and searched.
TRAIN_ROWS = 16_384
#: Inner products over this share of the norms are those that matter (ScaNN's threshold).
THRESHOLD = 0.2


@dataclass
class Codebook:
    centres: np.ndarray  # subspace, centre, dimension
    eta: float

    @property
    def dim(self) -> int:
        return len(self.centres) * WIDTH


def _pad(x: np.ndarray) -> np.ndarray:
    """Dimensions filled up with zeros to a multiple of four, so that two subspaces share a byte."""
    more = -x.shape[1] % (2 * WIDTH)
    return np.pad(x, ((0, 0), (0, more))) if more else x


def assign_codes(x: np.ndarray, book: Codebook, sweeps: int = 2) -> np.ndarray:
    """Codes by coordinate descent on the anisotropic loss, from the nearest centres on."""
    n, subs = len(x), len(book.centres)
    parts = x.reshape(n, subs, WIDTH)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    away = parts[:, :, None, :] - book.centres[None]  # row, subspace, centre, dimension
    square = (away**2).sum(3)
    along = (away * unit[:, :, None, :]).sum(3)
    codes = square.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(subs):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (square[:, m] + (book.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def train(x: np.ndarray, rounds: int = 6, seed: int = 7) -> Codebook:
    """A codebook of the rows of x: codes and centres take turns; centres solve their weighted least squares."""
    x = _pad(np.asarray(x, np.float64))
    n, dim = x.shape
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    subs = dim // WIDTH
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, subs, WIDTH)
    book = Codebook(parts[rng.permutation(max(n, CENTRES))[:CENTRES] % n].transpose(1, 0, 2).copy(), eta)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = np.concatenate([assign_codes(x[a : a + 4096], book) for a in range(0, n, 4096)])
        chosen = np.take_along_axis(book.centres[None], codes[:, :, None, None].astype(np.intp), 2)[:, :, 0]
        along = ((parts - chosen) * unit).sum(2)
        total = along.sum(1)
        for m in range(subs):
            rest = total - along[:, m] + (parts[:, m] * unit[:, m]).sum(1)  # parallel part were the centre zero
            outer = np.eye(WIDTH)[None] + (eta - 1) * unit[:, m, :, None] * unit[:, m, None, :]
            right = parts[:, m] + (eta - 1) * rest[:, None] * unit[:, m]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    book.centres[m, c] = np.linalg.lstsq(outer[own].sum(0), right[own].sum(0), rcond=None)[0]
                else:  # an empty centre starts again at a row
                    book.centres[m, c] = parts[rng.integers(n), m]
            total += ((parts[:, m] - book.centres[m][codes[:, m]]) * unit[:, m]).sum(1) - along[:, m]
    return book


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(queries: np.ndarray, packed: np.ndarray, book: Codebook) -> np.ndarray:
    """Approximate inner products, query by row, from one table of 256 sums for each byte of codes."""
    q = _pad(queries).reshape(len(queries), -1, WIDTH)
    tables = np.einsum("qmd,mcd->mqc", q, book.centres).astype(np.float32)
    out = np.zeros((len(queries), len(packed)), np.float32)
    for m in range(packed.shape[1]):
        pair = (tables[2 * m + 1][:, :, None] + tables[2 * m][:, None, :]).reshape(len(queries), 256)
        out += pair[:, packed[:, m]]
    return out


def takes_part(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _members(group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` rows of each group, filled up with -1 (more of one vector cannot be among most - 1 results), and
    the first row of each."""
    order = np.argsort(group, kind="stable")
    size = np.bincount(group)
    start = np.cumsum(size) - size
    place = np.arange(len(group)) - np.repeat(start, size)
    out = np.full((len(size), min(most, int(size.max()))), -1)
    kept = place < most
    out[group[order][kept], place[kept]] = order[kept]
    return out, out[:, 0]


def _reranked(rough: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Columns to score exactly, ascending, for runs of queries from the given one on: the ``most`` largest of each row and
    all that tie with the last of them. Runs are shorter where ties are many, which bounds what is scored at a time."""
    most = min(rough.shape[1], most)
    width = (rough >= np.partition(rough, -most, axis=1)[:, -most, None]).sum(1)
    at = 0
    while at < len(rough):
        n, widest = 1, int(width[at])
        while at + n < len(rough) and (n + 1) * max(widest, width[at + n]) <= max(len(rough) * most, widest):
            widest = max(widest, int(width[at + n]))
            n += 1
        yield at, np.sort(np.argpartition(rough[at : at + n], -widest, axis=1)[:, -widest:], axis=1)
        at += n


def search(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id", rerank: int = 400, rows_per_block: int = 8192, queries_per_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row that is_query names, the k rows of df with the largest
    inner product (in double precision) among those found, its own row left out; ties go to the smaller key.

    Vectors that are null, zero or hold null, NaN or infinite components take no part; those of each dimension are
    searched among their own. No rows, or no queries, give no rows. Repeated rows are rows of their own. Codebooks come
    from at most TRAIN_ROWS rows a dimension; every row is coded. Blocks hold bounded numbers of rows and queries by hash
    of the row, so equal keys or vectors gather nowhere; each pair of blocks is one group of bounded size, which reranks
    ``rerank`` different vectors a query exactly, with all whose rough score ties with the last of them, and passes on k
    rows. All codes are scanned for every query: a row is copied once for every ``queries_per_block`` queries."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(takes_part(F.col("v")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("q").alias("q"), F.count("*").alias("n")).where("q").orderBy("d").collect()}  # a row a dimension
    if not dims:
        return empty
    parts = [_search(rows.where(F.size("v") == d), n, k, rerank, rows_per_block, queries_per_block) for d, n in dims.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def _search(rows: DataFrame, n: int, k: int, rerank: int, rows_per_block: int, queries_per_block: int) -> DataFrame:
    """``search`` among n vectors of one dimension: id, v and q."""
    spark = rows.sparkSession
    hashed = F.xxhash64("id", "v")  # a task sends its share of the sample and little more
    few = rows.where(F.pmod(hashed, F.lit(1 << 30)) <= min(1 << 30, (1 << 30) * TRAIN_ROWS * 5 // (4 * n)))
    sample = few.orderBy(hashed, "id").limit(TRAIN_ROWS).select("v").toPandas()
    if not len(sample):  # all rows are copies of a few, which hash too high
        sample = rows.limit(1).select("v").toPandas()
    book = spark.sparkContext.broadcast(train(np.stack(sample["v"].to_numpy())))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                codes = pack(assign_codes(_pad(x), book.value))
                yield pa.record_batch([part.column("u"), part.column("id"), part.column("q"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], ["u", "id", "q", "v", "c"])

    coded = cut(rows.withColumn("u", F.monotonically_increasing_id()).transform(mapped, code, "u long, id long, q boolean, v binary, c binary"))
    counts = coded.agg(F.count("*"), F.sum(F.col("q").cast("long"))).first()
    over, parts = -(-counts[0] // rows_per_block), -(-counts[1] // queries_per_block)
    block = lambda n: F.pmod(F.xxhash64("u"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = coded.select("u", "id", "v", "c", block(over).alias("db"), every(parts).alias("qb"))
    queries = coded.where("q").select("u", "id", "v", block(parts).alias("qb"), every(over).alias("db"))

    def found(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qu": [], "query_id": [], "vec_id": [], "score": []}).astype({"qu": "int64", "query_id": "Int64", "vec_id": "Int64", "score": "float64"})
        if not len(d) or not len(q):
            return empty
        d = d.sort_values(["id", "u"], ignore_index=True)
        group, _ = pd.factorize(d["v"])  # equal vectors, numbered by their first row in order of id
        members, first = _members(group, k + 1)
        x = np.frombuffer(b"".join(d["v"].iloc[first]), np.float64).reshape(len(first), -1)
        packed = np.frombuffer(b"".join(d["c"].iloc[first]), np.uint8).reshape(len(first), -1)
        u, ids = d["u"].to_numpy(), d["id"].to_numpy()
        out = []
        for at in range(0, len(q), 128):
            own = q.iloc[at : at + 128]
            y = np.frombuffer(b"".join(own["v"]), np.float64).reshape(len(own), -1)
            for a, best in _reranked(scan(y, packed, book.value), rerank + 1):
                part = own.iloc[a : a + len(best)]
                score = np.einsum("qd,qrd->qr", y[a : a + len(best)], x[best])
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]  # vectors go by id: ties keep the smaller
                row = members[np.take_along_axis(best, top, 1)]  # query, vector, row of it or -1
                score = np.where((row < 0) | (u[row] == part["u"].to_numpy()[:, None, None]), -np.inf, np.take_along_axis(score, top, 1)[:, :, None])
                row, score = row.reshape(len(part), -1), score.reshape(len(part), -1)
                top = np.lexsort((row, -score), axis=1)[:, :k]
                hit = np.take_along_axis(row, top, 1).ravel()
                out.append(pd.DataFrame({"qu": np.repeat(part["u"].to_numpy(), top.shape[1]), "query_id": np.repeat(part["id"].to_numpy(), top.shape[1]), "vec_id": ids[hit], "score": np.take_along_axis(score, top, 1).ravel()}))
        out = pd.concat(out)
        return out[out["score"] != -np.inf]

    pairs = data.groupBy("qb", "db").cogroup(queries.groupBy("qb", "db")).applyInPandas(found, "qu long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qu").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op10_vector_search": op10_vector_search}
ORACLE_SQL = {
    "op10_vector_search": """
WITH e AS (SELECT row_number() OVER () AS u, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.u, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.u <> c.u WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
}

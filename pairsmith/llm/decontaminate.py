"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A window is a run of ``width`` consecutive words of an item (a shorter item is one window); its tokens are the shingles of
SHINGLE words in it (all its words as one, if they are fewer). Containment is exact, so a document must hold every token
of a window, and any one of them is a sufficient prefix: the rarest, by its count over all documents. Documents send only
the places of such prefix tokens, with the words around them; these meet the windows in a join on the token, under the
positional bound (the window must not begin before the text) and the length bound (nor end after it), and the words of
the window are compared with those of the text. A filter of bounded size, built from the benchmark and broadcast, keeps
other tokens of documents out of both passes; what it lets through by chance, the joins drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsmith.llm.base import cut, hidden, mapped, shuffles_end, slices, table
from pairsmith.llm.shingles import Words, sequences

#: Lower-cases A-Z and blanks all that is no word byte; bytes over 127 belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SHINGLE = 4
#: The filter: bits a token, bits at most (32 MB), places that are tested, and bits a row while it is built.
BITS, MOST_BITS, TESTS, CHUNK = 32, 1 << 28, 4, 1 << 15
#: Bytes of hits that are broadcast to the documents, at most.
BROADCAST = 32 << 20
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Filter:
    """Bits of the tokens that may be wanted."""

    def __init__(self, bits: int, chunks: dict[int, bytes]) -> None:
        self.bits, self.held = bits, np.zeros(bits // 8, np.uint8)
        for k, raw in chunks.items():
            own = np.frombuffer(raw, np.uint8)[: CHUNK // 8]
            self.held[k * CHUNK // 8 :][: len(own)] = own[: len(self.held)]

    @staticmethod
    def places(prints: np.ndarray, bits: int, test: int) -> np.ndarray:
        return prints * _SPREAD[test] >> np.uint64(65 - bits.bit_length())

    def passes(self, prints: np.ndarray) -> np.ndarray:
        """Which of the fingerprints may be wanted, ascending."""
        own = np.arange(len(prints))
        for test in range(TESTS):
            at = self.places(prints[own], self.bits, test)
            own = own[(self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return own

    @staticmethod
    def of(tokens: DataFrame) -> Filter | None:
        """From rows (tok); None if there are none. Only chunks of bits come to the driver, MOST_BITS in all."""
        n = tokens.count()
        if not n:
            return None
        bits = min(MOST_BITS, 1 << max(6, (BITS * n - 1).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints = batch.column("tok").to_numpy().view(np.uint64)
                for test in range(TESTS):
                    yield pa.record_batch([pa.array(Filter.places(prints, bits, test).view(np.int64))], ["at"])

        at = tokens.transform(mapped, run, "at long")
        with shuffles_end(tokens.sparkSession):
            rows = at.groupBy(F.expr(f"at div {CHUNK}").alias("k")).agg(F.expr(f"bitmap_construct_agg(at % {CHUNK})").alias("raw")).collect()
        return Filter(bits, {r.k: bytes(r.raw) for r in rows})


def windows(benchmark: DataFrame, width: int, item_id: str, item_text: str) -> DataFrame:
    """item, w (the window's words, joined by spaces), k (their number) and toks (fingerprints of its tokens, in order)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("_text")).where("item is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 18):
                own = Words(part.column("_text").cast(pa.binary()).to_pylist(), FOLD)
                words, prints = own.data.split(), own.prints()
                rows: list[tuple] = []
                for item, base, n in zip(part.column("item").to_pylist(), own.base.tolist(), own.count.tolist(), strict=False):
                    if n:
                        k = min(n, width)
                        q = min(k, SHINGLE)
                        toks = sequences(prints, np.arange(base, base + n - q + 1), q).view(np.int64)
                        rows.extend((item, b" ".join(words[base + i : base + i + k]), k, toks[i : i + k - q + 1]) for i in range(n - k + 1))
                types = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["item", "w", "k", "toks"])

    return items.transform(mapped, run, "item long, w string, k int, toks array<long>")


def _counted(texts: DataFrame, wanted, widths: list[int]) -> DataFrame:
    """tok and n, its count over all texts, for tokens that pass the filter. A task sends each of them once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for part in slices(batch, "_text", 1 << 19):
                own = Words(part.column("_text").cast(pa.binary()).to_pylist(), FOLD)
                prints = own.prints()
                for q in widths:
                    rows = sequences(prints, own.places(q)[0], q)
                    found.append(rows[wanted.value.passes(rows)])
            toks, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(toks.view(np.int64)), pa.array(n)], ["tok", "n"])

    return texts.select("_text").transform(mapped, run, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))


def _places(texts: DataFrame, wanted, widths: list[int], width: int, longest: int) -> DataFrame:
    """_h, _g (the text's key), tok, p (the word at which it begins), n (words of the text), c and around (the words from p - c
    on that a window could hold; words longer than any of an item are empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                own = Words(part.column("_text").cast(pa.binary()).to_pylist(), FOLD)
                prints = own.prints()
                text, at, tok = [], [], []
                for q in widths:
                    place, of = own.places(q)
                    rows = sequences(prints, place, q)
                    hit = wanted.value.passes(rows)
                    text.append(of[hit])
                    at.append(place[hit])
                    tok.append(rows[hit])
                text, at, tok = map(np.concatenate, (text, at, tok))
                first = np.maximum(at - width + 1, own.base[text])
                stop = np.minimum(at + width, own.base[text + 1])
                data, begin, end = own.data, own.begin.tolist(), own.end.tolist()
                around = [[data[begin[i] : end[i]] if end[i] - begin[i] <= longest else b"" for i in range(a, b)] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                yield pa.record_batch(
                    [*(part.column(c).take(pa.array(text)) for c in ("_h", "_g")), pa.array(tok.view(np.int64)), pa.array(at - own.base[text], pa.int32()), pa.array(own.count[text], pa.int32()), pa.array(at - first, pa.int32()), pa.array(around, pa.list_(pa.string()))],
                    ["_h", "_g", "tok", "p", "n", "c", "around"],
                )

    return texts.transform(mapped, run, "_h long, _g long, tok long, p int, n int, c int, around array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_items: int = 2, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (disjoint spans of word positions, end exclusive), items (ascending ids whose windows
    occur) and contaminated (at least min_items items).

    Null and empty texts have no words, no hits and are not contaminated; items without words or id take no part, rows
    with one item_id are one item; an empty benchmark hits nothing, empty docs give an empty table. Added columns replace
    those of the same names; all others pass unchanged. What a text holds depends on nothing but the text: copies are
    searched as one (by 128 bits of hash), so thousands of them, or a passage in a third of all rows, meet in no task. The
    hits come back in a join by that key: up to BROADCAST bytes of them are sent to the documents; more are met in a
    shuffle, which Spark splits where a key is hot."""
    added = ["n_words", "hit_spans", "items", "contaminated"]
    docs, own = hidden(docs.drop(*added))
    text = {c: new for new, c in own.items()}.get(text, text)
    key = {"_h": F.xxhash64(F.lit(1), F.col(text)), "_g": F.xxhash64(F.lit(2), F.col(text))}
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    found = _found(docs.select(F.col(text).alias("_text"), *(c.alias(k) for k, c in key.items())).where("_text <> ''"), cut(windows(benchmark, width, item_id, item_text)), width)
    if found is None:
        out = docs.withColumns({"n_words": n_words, "hit_spans": F.lit(None).cast("array<struct<s:int,e:int>>"), "items": F.lit(None).cast("array<bigint>")})
    else:
        found = cut(found)
        size = found.agg(F.sum(F.size("hit_spans") * 16 + F.size("items") * 8 + 64)).first()[0] or 0
        found = F.broadcast(found) if size <= BROADCAST else found
        out = docs.withColumns({"n_words": n_words, **key}).join(found, ["_h", "_g"], "left").drop("_h", "_g")
    out = out.withColumns({"hit_spans": F.coalesce("hit_spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<bigint>)"))})
    return out.withColumn("contaminated", F.size("items") >= min_items).select(*docs.columns, *added).withColumnsRenamed(own)


def _found(texts: DataFrame, held: DataFrame, width: int) -> DataFrame | None:
    """_h, _g, hit_spans and items of the texts in which windows occur; None if there is no window to find."""
    sc = texts.sparkSession.sparkContext
    wanted = Filter.of(held.select(F.explode("toks").alias("tok")).distinct())
    if wanted is None:
        return None
    widths = sorted({min(r.k, SHINGLE) for r in held.select("k").distinct().collect()})  # at most ``width`` rows
    longest = held.agg(F.max(F.array_max(F.transform(F.split("w", " "), F.octet_length)))).first()[0]
    each = held.select("w", "k", "toks").dropDuplicates(["w"]).select("w", "k", F.posexplode("toks").alias("at", "tok"))
    counts = _counted(texts, sc.broadcast(wanted), widths)
    prefix = each.join(counts, "tok").groupBy("w", "k").agg(F.count("*").alias("seen"), F.min(F.struct("n", "tok", "at")).alias("x"))
    tokens = F.col("k") - F.least(F.col("k"), F.lit(SHINGLE)) + 1
    prefix = cut(prefix.where(F.col("seen") == tokens).select("w", "k", "x.tok", "x.at"))  # others have a token that no text holds
    wanted = Filter.of(prefix.select("tok").distinct())
    if wanted is None:
        return None
    places = _places(texts, sc.broadcast(wanted), widths, width, longest).dropDuplicates(["_h", "_g", "p", "tok"])
    start, stop = F.col("p") - F.col("at"), F.col("p") - F.col("at") + F.col("k")
    there = F.array_join(F.slice("around", F.col("c") - F.col("at") + 1, F.col("k")), " ") == F.col("w")
    hits = cut(places.join(prefix, "tok").where((start >= 0) & (stop <= F.col("n"))).where(there).select("_h", "_g", start.alias("s"), stop.alias("e"), "w"))
    # spans that overlap or touch are one
    one = Window.partitionBy("_h", "_g").orderBy("s", "e")
    spans = hits.select("_h", "_g", "s", "e").distinct().withColumn("before", F.max("e").over(one.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_h", "_g", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("_h", "_g").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("hit_spans"))
    owners = held.select("w", "item").distinct()
    items = hits.select("_h", "_g", "w").distinct().join(owners, "w").groupBy("_h", "_g").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(items, ["_h", "_g"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[i : i + least(8, len(w)) - 1] AS g FROM b, range(1, greatest(1, len(w) - 7) + 1) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
occ AS (SELECT r, i, k, w[i : i + k - 1] AS g FROM d, sizes, range(1, len(w) - k + 2) t(i) WHERE len(w) >= k),
hits AS (SELECT r, i, k, item_id FROM occ JOIN win USING (g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits), range(i, i + k) t(p) GROUP BY 1),
its AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
}

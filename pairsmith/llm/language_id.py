"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the likelihood of the text under character trigram models, the language
that the markup or record declares, the suffix of the address, and a prior of the host. Counts of text-only decisions,
aggregated by host, domain and suffix, give the priors; each level is smoothed towards the one above it. How far a
declaration is to be trusted is counted as well. A uniform model of unknown text competes with the languages.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm.base import cut, hidden, mapped, slices, table

BUCKETS = 1 << 14
#: Stands for all declared languages that have no model; no declaration reads like this.
OTHER = "-"
#: Rows of each declared language from which its trigram model is fitted, about; everything else covers all rows.
TRAIN_ROWS = 1_000
#: If more languages than this are declared, those need ENOUGH_ROWS rows for a model that are not among the commonest.
FEW_LANGUAGES, ENOUGH_ROWS = 64, 20
#: Hosts whose priors are broadcast, with up to 64 languages; more are joined by shuffle.
BROADCAST_HOSTS = 50_000
#: Neighbouring trigrams overlap, so their evidence counts less than independent evidence would.
TEMPER = 0.5


@functools.cache
def folded() -> np.ndarray:
    """Lower-case letter of each code point, 0 for all that is no letter or mark."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams (letters, and one blank for what stands between them), where each text's begin, and
    whether each lies within one text."""
    joined = "\0".join(texts) + "\0"
    g = folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    keep = np.empty(len(g), bool)
    keep[0], keep[1:] = True, (g[1:] != 0) | (g[:-1] != 0)
    keep[ends - 1] = True
    keep[np.concatenate(([0], ends[:-1]))] = True
    left = np.cumsum(keep)
    bounds = np.concatenate(([0], left[ends - 1]))
    g = np.concatenate((g[keep], np.zeros(2, np.uint32))).astype(np.uint64)
    h = (g[:-2] * np.uint64(0x9E3779B97F4A7C15) + g[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + g[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    within = np.ones(len(h), bool)
    within[np.maximum(bounds[1:] - 1, 0)] = within[np.maximum(bounds[1:] - 2, 0)] = False
    return (h % np.uint64(BUCKETS)).astype(np.int64), bounds[:-1], within


class Model:
    """Log probabilities of trigram buckets, one column a language and a last one for unknown text."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        p = counts + 0.5
        self.table = np.concatenate([np.log(p / p.sum(0)), np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        tri, begins, within = trigrams(texts)
        out = np.empty((len(texts), self.table.shape[1]))
        for at in range(0, out.shape[1], 16):  # so many languages at a time, which bounds the memory
            score = self.table[:, at : at + 16][tri]
            score[~within] = 0
            out[:, at : at + 16] = np.add.reduceat(score.astype(np.float64), begins, axis=0) * TEMPER
        return out


def normal_language(declared: Column) -> Column:
    """The primary subtag of a declaration such as en-GB or EN_us."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(declared), "^([A-Za-z]{2,8})", 1)), F.lit(""))


def fit(df: DataFrame, declared: str, text: str, key: str) -> Model | None:
    """A trigram model of each declared language, from about TRAIN_ROWS of its rows, or all if there are no more.

    The languages are counted over all rows. The rows of each are those whose hash of key and declaration is small enough
    for its count, and that of the least hash (rows that share it come together), so a common language takes no row of a
    rare one, and a rerun or another partitioning draws the same. Null texts do not count."""
    rows = df.select(F.col(key).alias("k"), normal_language(F.col(declared)).alias("lang"), F.col(text).alias("_text")).where("lang is not null and _text is not null")
    hashed = F.xxhash64("k", "lang")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(hashed).alias("least")).orderBy(F.desc("n"), "lang")
    enough = found.limit(FEW_LANGUAGES).collect()
    if len(enough) == FEW_LANGUAGES and enough[-1].n >= ENOUGH_ROWS:
        enough = found.where(F.col("n") >= ENOUGH_ROWS).collect()
    if not enough:
        return None
    last = {x.lang: 2**63 - 1 if x.n <= TRAIN_ROWS else max(x.least, 2**64 * TRAIN_ROWS // x.n - 2**63) for x in enough}
    bounds = df.sparkSession.createDataFrame(list(last.items()), "lang string, last long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "_text", 1 << 18):
                tri, begins, within = trigrams(part.column("_text").to_pylist())
                ends = [*begins[1:].tolist(), len(tri)]
                for lang, a, b in zip(part.column("lang").to_pylist(), begins.tolist(), ends, strict=True):
                    held[lang] = held.get(lang, 0) + np.bincount(tri[a:b][within[a:b]], minlength=BUCKETS)
        for lang, n in held.items():
            own = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(n[own], pa.int64())], ["lang", "bucket", "n"])

    chosen = rows.join(F.broadcast(bounds), "lang").where(hashed <= F.col("last")).select("lang", "_text")
    counts = chosen.transform(mapped, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))  # those with text
    if not languages:
        return None
    out = np.zeros((BUCKETS, len(languages)))
    np.add.at(out, (counts["bucket"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)), counts["n"].to_numpy())
    return Model(languages, out)


def _likelihoods(df: DataFrame, model, text: str, keep: list[str], trust=None) -> DataFrame:
    """With trust, the log probabilities of the row's _tag in each language are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 18):
                texts = pc.fill_null(part.column(text), "").to_pylist()
                got = model.value.likelihoods(texts)
                if trust is not None:
                    for i, tag in enumerate(part.column("_tag").to_pylist()):
                        if tag in trust.value:
                            got[i, :-1] += trust.value[tag]
                got = pa.array(list(got), pa.list_(pa.float64()))
                letters = pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), got, letters], [*keep, "_ll", "_letters"])

    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "_ll array<double>, _letters boolean"])
    return df.transform(mapped, run, ddl)


def identify(df: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", key: str = "doc_id", model: Model | None = None, strength: float = 20.0) -> DataFrame:
    """df with lang_id (null if unknown), lang_confidence (posterior of the likeliest) and lang_accepted.

    declared: column with a language tag. host: column with a host or address; its registered part and its suffix are
    the levels above it. Rejected are texts without letters (null and empty ones too: confidence 0) and texts that the
    uniform model explains better than any language, unless they declare a language that has no model: that is then
    lang_id, and the posterior of the uniform model the confidence. Missing declarations and hosts are no evidence;
    repeated rows are decided alike; ties go to the language first in the alphabet. Without a model one is fitted on the
    declarations; if there are none, nothing is known and every text with letters is accepted with lang_id null. An empty
    table gives an empty one. Columns of the added names are replaced; all others pass unchanged, whatever their names.

    The texts are read twice, for the counts and for the result: to keep the likelihoods of the first time would mean to
    write or to shuffle all texts with them. Rows move only if there are more than BROADCAST_HOSTS hosts; the join with their priors is then an ordinary one,
    which Spark splits where a host is hot. Counts are aggregated before they are shuffled."""
    spark = df.sparkSession
    added = ["lang_id", "lang_confidence", "lang_accepted"]
    df, own = hidden(df.drop(*added))
    text, declared, host, key = ({c: new for new, c in own.items()}.get(x, x) for x in (text, declared, host, key))
    if model is None and declared:
        model = fit(df, declared, text, key)
    if model is None:
        letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
        return df.withColumns({"lang_id": F.lit(None).cast("string"), "lang_confidence": F.lit(0.0), "lang_accepted": letters}).withColumnsRenamed(own)
    sent, langs, n = spark.sparkContext.broadcast(model), model.languages, len(model.languages)
    address = F.lower(F.coalesce(F.col(host), F.lit(""))) if host else F.lit("")
    name = F.regexp_replace(F.regexp_replace(address, "^[a-z][a-z0-9+.-]*://", ""), "[/?#:].*$", "")
    levels = {"_host": name, "_domain": F.regexp_extract(name, r"([^.]+\.[^.]+)$|([^.]*)$", 0), "_suffix": F.regexp_extract(name, r"\.([^.]+)$", 1)}
    tag = normal_language(F.col(declared)) if declared else F.lit(None).cast("string")
    said = F.when(~tag.isin(langs), tag)
    tag = F.when(tag.isin(langs), tag).when(tag.isNotNull(), F.lit(OTHER))

    # what the texts alone say, counted by host and declaration
    base = df.select(F.col(text).alias("_text"), tag.alias("_tag"), *(c.alias(k) for k, c in levels.items()))
    alone = _likelihoods(base, sent, "_text", ["_tag", *levels])
    top = (F.array_position("_ll", F.array_max("_ll")) - 1).cast("int")
    alone = alone.where("_letters").select("_tag", *levels, top.alias("_top")).where(F.col("_top") < n)
    cells = [F.sum((F.col("_top") == i).cast("long")).alias(f"c{i}") for i in range(n)]
    c = [f"c{i}" for i in range(n)]
    sums = [F.sum(x).alias(x) for x in c]
    counted = cut(alone.groupBy("_tag", *levels).agg(*cells))
    by_tag = {r["_tag"]: [r[x] for x in c] for r in counted.groupBy("_tag").agg(*sums).collect()}  # one row a language
    total = [sum(r[i] for r in by_tag.values()) for i in range(n)]
    whole = F.array(*(F.lit((t + 1) / (sum(total) + n)) for t in total))

    def smoothed(counts: list[str], above: Column) -> Column:
        own = F.array(*(F.col(c).cast("double") for c in counts))
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda c, p: (c + strength * p) / (size + strength))

    by_host = counted.groupBy(*levels).agg(*sums)
    by_domain = by_host.groupBy("_domain", "_suffix").agg(*sums)
    suffix = by_domain.groupBy("_suffix").agg(*sums).select("_suffix", smoothed(c, whole).alias("_up"))
    domain = by_domain.join(suffix, "_suffix").select("_domain", smoothed(c, F.col("_up")).alias("_up"))
    priors = cut(by_host.join(domain, "_domain").select("_host", smoothed(c, F.col("_up")).alias("_prior")))
    if priors.limit((most := BROADCAST_HOSTS * 64 // max(n, 64)) + 1).count() <= most:
        priors = F.broadcast(priors)

    # P(declaration | language), counted; a missing declaration is no evidence
    tags = [t for t in by_tag if t is not None]
    known = sum(sum(by_tag[t]) for t in tags)
    trust = {t: [np.log((by_tag[t][i] + 0.5 + 0.5 * (t == langs[i])) / (sum(by_tag[u][i] for u in tags) + 0.5 * len(tags) + 0.5)) for i in range(n)] for t in tags} if known else {}
    trust = spark.sparkContext.broadcast({t: np.array(x) for t, x in trust.items()})

    kept = df.columns
    scored = _likelihoods(df.withColumns({"_host": levels["_host"], "_tag": tag, "_said": said}), sent, text, [*kept, "_host", "_tag", "_said"], trust)
    scored = scored.join(priors, "_host", "left")
    prior = F.coalesce(F.col("_prior"), whole)
    scored = scored.withColumn("_known", F.zip_with(F.slice("_ll", 1, n), prior, lambda a, p: a + F.log(p)))
    scored = scored.withColumn("_best", F.array_max("_known"))
    unknown = F.element_at("_ll", n + 1)
    mass = F.aggregate(F.col("_known"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    modelled = F.col("_best") >= unknown + F.log(F.lit(0.02))
    accepted = F.col("_letters") & (modelled | F.col("_said").isNotNull())
    which = F.element_at(F.array(*map(F.lit, langs)), F.array_position("_known", F.col("_best")).cast("int"))
    which = F.when(modelled, which).otherwise(F.col("_said"))
    rest = F.exp(F.least(unknown + F.log(F.lit(0.02)) - F.col("_best"), F.lit(700.0)))
    confidence = F.when(F.col("_letters"), F.when(modelled | F.col("_said").isNull(), F.lit(1.0)).otherwise(rest) / (mass + rest)).otherwise(0.0)
    out = scored.select(*kept, F.when(accepted, which).alias("lang_id"), confidence.alias("lang_confidence"), accepted.alias("lang_accepted"))
    return out.withColumnsRenamed(own)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs).select("doc_id", F.col("lang").alias("declared"), "lang_id", F.round("lang_confidence", 6).alias("confidence"), F.col("lang_accepted").alias("accepted"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}

"""A training corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm.base import dropped, hidden, small_batches, table, written
from pairsmith.llm.decontaminate import contamination
from pairsmith.llm.language_id import identify
from pairsmith.llm.near_duplicates import one_of_each
from pairsmith.llm.personal_data import detect, redact
from pairsmith.llm.piece_codec import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters (null and empty texts too) or in no modelled language go.
    Repeated rows are decided alike; without any declaration all documents with letters stay. An empty table gives an
    empty one; all columns pass as they are, whatever their names."""
    small_batches(spark)
    added = ("lang_id", "lang_confidence", "lang_accepted")
    rows, own = hidden(docs, *added)
    return identify(rows).where("lang_accepted").drop(*added).withColumnsRenamed(own).select(*docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id (then text hash), a null id before
    others; of rows equal in id and text one. Documents without words (null, empty) all stay but for such repeats. An
    empty table gives an empty one; all columns pass as they are, whatever their names."""
    small_batches(spark)
    return one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts, and all documents if the benchmark is
    empty, stay; repeated rows are decided alike. An empty table gives an empty one; all columns pass as they are."""
    small_batches(spark)
    added = ("n_words", "hit_spans", "items", "contaminated")
    rows, own = hidden(docs, *added)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), min_items=1)
    return found.where(~F.col("contaminated")).drop(*added).withColumnsRenamed(own).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew. Null texts stay null (n_chars too),
    empty ones empty; of overlapping spans the first gives its kind. All rows and all other columns pass as they are."""
    rows, own = hidden(docs, "pii")
    found = redact(detect(rows)).drop("pii").withColumnsRenamed(own)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their number, with the check that they decode to the text. Null and empty texts have no ids;
    repeated rows stay; other columns go."""
    import public_tokenizers

    small_batches(spark)

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("language", language), ("duplicates", duplicates), ("leaks", leaks), ("personal", personal), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Between stages tables are written to the checkpoint folder, each deleted when the next
    has been written, the last when the driver ends."""
    docs, before = STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir), None
    for _, stage in STAGES[1:]:
        docs, path = written(docs)
        if before:
            dropped(spark, before)
        docs, before = stage(spark, docs, sf_dir), path
    return docs

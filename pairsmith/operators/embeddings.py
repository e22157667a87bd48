"""Value vectors (V1, V2): word vectors trained on a table's own values; any table of (value, vec) can stand in for them."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.functions import tokens


def _words(values: DataFrame, value: str) -> DataFrame:
    return values.select(F.col(value).alias("value")).where("value <> ''").distinct().withColumn("words", tokens.simple_preprocess(F.col("value")))


def train_vectors(values: DataFrame, value: str = "value", dim: int = 50, min_count: int = 2, rounds: int = 40, parts: int = 1, seed: int = 0) -> Word2VecModel:
    """V1: skip-gram vectors of the words of all distinct values, of words that occur min_count times at least. Each of
    ``parts`` partitions learns on its own and their vectors are averaged every round; the result is repeatable for one
    partition and given rows. What the driver holds grows with the vocabulary alone, which min_count bounds."""
    rows = _words(values, value).where(F.size("words") > 0).orderBy("value")
    return Word2Vec(vectorSize=dim, minCount=min_count, maxIter=rounds, numPartitions=parts, seed=seed, inputCol="words", outputCol="vec").fit(rows)


def value_vectors(model: Word2VecModel, values: DataFrame, value: str = "value") -> DataFrame:
    """V1: value and vec, the mean of the vectors of its words, for each distinct value; zeros if none is known."""
    return model.transform(_words(values, value)).select("value", vector_to_array("vec").alias("vec"))


def word_vectors(model: Word2VecModel, values: DataFrame, value: str = "value") -> DataFrame:
    """V2: value and vecs, the vectors of its known distinct words in word order, for values with a known word."""
    known = model.getVectors().select("word", vector_to_array("vector").alias("v"))
    each = _words(values, value).select("value", F.explode(F.array_distinct("words")).alias("word")).join(known, "word")
    return each.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "v"))), lambda x: x["v"]).alias("vecs"))

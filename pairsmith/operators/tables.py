"""Cleaning, typing and labelling of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsmith.functions import tokens

#: Attribute types from the most to the least specific.
TYPES = ("boolean", "numeric", "str_eq_1w", "str_bt_1w_5w", "str_bt_5w_10w", "str_gt_10w", "un_determined")


def check_same_schema(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError(f"attributes differ: {a.columns} and {b.columns}")


def as_table(df: DataFrame, key: str) -> DataFrame:
    """A linkage table: _id, then all other columns as strings with empty ones null."""
    return df.select(F.col(key).cast("long").alias("_id"), *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c != key))


def perfect(df: DataFrame) -> DataFrame:
    """Rows without missing attributes."""
    return df.dropna("any")


def fill_nulls(df: DataFrame) -> DataFrame:
    """P3: 'none' for strings, 0 for numbers."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    out = df.fillna("none", text) if text else df
    return out.fillna(0, numbers) if numbers else out


def impute(df: DataFrame, features: list[str], strategy: str = "mean") -> DataFrame:
    """Missing features become their column's mean, or 0."""
    if strategy == "constant":
        return df.fillna(0.0, features)
    means = df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in features))  # one row
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in features}).drop(*(f"_m_{c}" for c in features))


def for_external_matcher(pairs: DataFrame) -> DataFrame:
    """Columns of a pair table renamed for matchers that expect left_ and right_."""
    return pairs.toDF(*("left_" + c[7:] if c.startswith("ltable_") else "right_" + c[7:] if c.startswith("rtable_") else "id" if c == "_id" else c for c in pairs.columns))


def informative(df: DataFrame, features: list[str]) -> list[str]:
    """Features with more than one value."""
    one = df.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(features)), *(F.max(c).alias(f"b{i}") for i, c in enumerate(features))).first()
    return [c for i, c in enumerate(features) if one[f"a{i}"] is not None and one[f"a{i}"] != one[f"b{i}"]]


def attribute_types(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Attr and type, from one pass: boolean or numeric if all values are, else by the average number of words."""
    sums = []
    for i, c in enumerate(attrs):
        v = F.nullif(F.col(c).cast("string"), F.lit(""))
        n = F.size(tokens.pieces(v, " \t\r\n"))
        sums += [F.count(v).alias(f"n{i}"), F.sum(v.try_cast("double").isNotNull().cast("int")).alias(f"d{i}"), F.sum(F.lower(v).isin("true", "false").cast("int")).alias(f"b{i}"), F.avg(F.when(v.isNotNull(), n)).alias(f"w{i}")]
    one = df.agg(*sums)

    def kind(i: int) -> Column:
        n, w = F.col(f"n{i}"), F.col(f"w{i}")
        return F.when(n == 0, "un_determined").when(F.col(f"b{i}") == n, "boolean").when(F.col(f"d{i}") == n, "numeric").when(w <= 1, "str_eq_1w").when(w <= 5, "str_bt_1w_5w").when(w <= 10, "str_bt_5w_10w").otherwise("str_gt_10w")

    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), kind(i).alias("type")) for i, c in enumerate(attrs)))).alias("x")).select("x.*")


def reconcile(left: dict[str, str], right: dict[str, str]) -> dict[str, str]:
    """One type for each attribute of both tables, the less specific of the two."""
    return {a: max(t, right.get(a, t), key=TYPES.index) for a, t in left.items()}


def representative(df: DataFrame, attrs: list[str]) -> DataFrame:
    """The attribute with the largest distinct token vocabulary, with its size (the first by name of equals)."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), tokens.dlm(F.col(c)).alias("toks")) for c in attrs))).alias("x")).select("x.attr", F.explode("x.toks").alias("tok"))
    return each.distinct().groupBy("attr").agg(F.count("*").alias("n_tokens")).orderBy(F.desc("n_tokens"), "attr").limit(1)


def average_by_attribute(df: DataFrame, features: list[str]) -> DataFrame:
    """One column avg_<attribute> for all features of an attribute."""
    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(f.split("_")[0], []).append(f)
    out = {f"avg_{a}": F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in fs), F.lit(0.0)), sum((F.col(c).isNotNull().cast("int") for c in fs), F.lit(0))) for a, fs in groups.items()}
    return df.withColumns(out)


def slim(pairs: DataFrame, by: str, other: str, score: str = "score") -> DataFrame:
    """The best partner of each id in ``by`` (ties to the smaller partner), by aggregation rather than a window."""
    best = pairs.groupBy(by).agg(F.max_by(F.struct(other, score), F.struct(F.col(score), -F.col(other))).alias("x"))
    return best.select(by, f"x.{other}", f"x.{score}")


def nearest(pairs: DataFrame, by: str, k: int, other: str, score: str = "score") -> DataFrame:
    """The k best partners of each id in ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), other))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def histogram(df: DataFrame, value: str, bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts of a score in equal bins (the last holds its upper end)."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))

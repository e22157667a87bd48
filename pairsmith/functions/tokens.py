"""Tokenizers (T1-T9) as Column builders: each turns a string into an array of distinct tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters of the default tokenizer, and of the wider set used for blocking features.
DELIMITERS = " \"',\\\t\r\n"
BLOCKING_DELIMITERS = " .,\\\t\r\n"
CJK_MARKS = "[。，？！；：、（）「」“”‘’《》【】—～　]"


def _class(delimiters: str) -> str:
    return "[" + "".join({"\\": r"\\", "\t": r"\t", "\r": r"\r", "\n": r"\n"}.get(c, c) for c in delimiters) + "]+"


def pieces(c: Column, delimiters: str = DELIMITERS) -> Column:
    """Non-empty parts between delimiters, repeats kept."""
    return F.filter(F.split(c, _class(delimiters)), lambda x: x != "")


def dlm(c: Column, delimiters: str = DELIMITERS) -> Column:
    """Case-sensitive parts between delimiters."""
    return F.array_distinct(pieces(c, delimiters))


def qgm(c: Column, q: int = 3) -> Column:
    """Windows of q characters that are ASCII letters and digits throughout."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substr(c, i, F.lit(q)))
    kept = F.array_distinct(F.filter(grams, lambda g: g.rlike(f"^[A-Za-z0-9]{{{q}}}$")))
    return F.when(F.length(c) >= q, kept).when(c.isNotNull(), F.array().cast("array<string>"))


def wspace(c: Column) -> Column:
    """Parts between spaces."""
    return dlm(c, " ")


def alphanumeric(c: Column) -> Column:
    """T4: runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), F.lit(1)))


def normalise(c: Column, strategy: int = 0) -> Column:
    """Lower case, and spaces collapsed (0), only letters and digits (1), or those with single spaces (2)."""
    low = F.lower(c)
    if strategy == 1:
        return F.regexp_replace(low, "[^a-z0-9]", "")
    if strategy == 2:
        low = F.regexp_replace(low, "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(low, " +", " "))


def simple_preprocess(c: Column, least: int = 2, most: int = 15) -> Column:
    """Lower-cased words of letters, between least and most long, repeats kept."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: F.length(x).between(least, most))


def delimited_alnum(c: Column) -> Column:
    """T1 tokens with a letter or digit in them."""
    return F.filter(dlm(c), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def replace_cjk_marks(c: Column, by: str = "#") -> Column:
    """Full-width punctuation replaced."""
    return F.regexp_replace(c, CJK_MARKS, by)


TOKENIZERS: dict[str, Callable[..., Column]] = {"dlm": dlm, "qgm": qgm, "wspace": wspace, "alphanumeric": alphanumeric}


def tokenizer(name: str, setting: str | None = None) -> Callable[[Column], Column]:
    """The tokenizer of a rule: ``qgm`` takes its q from the setting."""
    if name == "qgm":
        return lambda c: qgm(c, int(setting or 3))
    return TOKENIZERS[name]


def idf(tokens: DataFrame, records: int | Column, token: str = "tok") -> DataFrame:
    """(token, df, w) with w = log10(records / df) from one row a record and distinct token."""
    n = F.lit(records) if isinstance(records, int) else records
    return tokens.groupBy(token).agg(F.count("*").alias("df")).withColumn("w", F.log10(n / F.col("df")))


def record_weights(tokens: DataFrame, weights: DataFrame, key: str, token: str = "tok") -> DataFrame:
    """A2: (key, weight): the sum of the weights of a record's tokens."""
    return tokens.join(weights.select(token, "w"), token).groupBy(key).agg(F.sum("w").alias("weight"))

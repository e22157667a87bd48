"""Readers and writers (S1-S18): CSV and Parquet tables, pair tables, results, value graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsmith.functions import tokens
from pairsmith.operators import blocking, tables

#: Columns renamed on reading.
RENAMED = {"id": "_id", "categb ry": "category"}


def read_csv(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """RFC 4180 with a header; rows of another width go; empty cells are null; all columns but _id are text."""
    head = spark.read.csv(path, header=True, quote='"', escape='"').columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED")
    return _table(df, normalise)


def _table(df: DataFrame, normalise: bool) -> DataFrame:
    df = df.toDF(*(RENAMED.get(c, c) for c in df.columns))
    clean = lambda c: F.nullif(tokens.normalise(F.col(c).cast("string")) if normalise else F.col(c).cast("string"), F.lit(""))
    return df.select(*(F.col(c).try_cast("long").alias(c) if c == "_id" else clean(c).alias(c) for c in df.columns))


def read_parquet(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """S4."""
    return _table(spark.read.parquet(path), normalise)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return df.select(*(F.col(c).try_cast("long").alias(f"id{i + 1}") for i, c in enumerate(df.columns[:2])))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths in a directory of any file system that Spark reads, by name, without hidden ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(str(x.getPath().toString()) for x in found if not x.getPath().getName().startswith(("_", ".")))


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_directory(spark: SparkSession, path: str, normalise: bool = False) -> dict[str, DataFrame]:
    """Every CSV file of a directory as a table, by its name without the ending."""
    return {_stem(f): read_csv(spark, f, normalise) for f in _files(spark, path) if f.lower().endswith(".csv")}


def load_tables(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """A, B (if there are two tables) and gold from a directory or from paths, CSV or Parquet.

    Of paths the last is gold: two are a self join, three have two tables. In a directory gold is the file whose name
    begins so, and the others are the tables by name; of four files, ``table_a`` is the only table."""
    if isinstance(paths, str):
        files = [f for f in _files(spark, paths) if f.lower().endswith((".csv", ".parquet"))]
        gold, rest = [f for f in files if _stem(f).lower().startswith("gold")], [f for f in files if not _stem(f).lower().startswith("gold")]
        if len(files) == 4:
            rest = [f for f in rest if _stem(f).lower() == "table_a"]
        if len(gold) != 1 or not rest:
            raise ValueError(f"one gold file and one or two tables are expected in {paths}")
        paths = [*rest, *gold]
    read = lambda p: read_parquet(spark, p) if p.endswith(".parquet") else read_csv(spark, p)
    if len(paths) == 2:
        return {"A": read(paths[0]), "gold": read_gold(spark, paths[1])}
    if len(paths) != 3:
        raise ValueError("one or two tables and a gold file are expected")
    out = {"A": read(paths[0]), "B": read(paths[1]), "gold": read_gold(spark, paths[2])}
    tables.check_same_schema(out["A"], out["B"])
    return out


def write_csv(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Quotes only where needed, doubled inside; files of at most so many rows, if given."""
    out = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    out.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_pairs(pairs: DataFrame, path: str, a: DataFrame | None = None, b: DataFrame | None = None, attrs: list[str] | None = None, rows_per_file: int = 0) -> None:
    """Pairs as ids (p1, p2), or with both rows' attributes, as Parquet."""
    out = pairs.select(F.col("ltable_id").alias("p1"), F.col("rtable_id").alias("p2")) if a is None else blocking.attach(pairs, a, b, attrs or [c for c in a.columns if c != "_id"])
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_chunks(pairs: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A result in files of at most so many rows under ``pairs``, and its counts as one row under ``stat``: n_files and
    n_pairs, read back from what was written."""
    write_csv(pairs, f"{path}/pairs", rows_per_file)
    back = pairs.sparkSession.read.schema(pairs.schema).csv(f"{path}/pairs", header=True, quote='"', escape='"', multiLine=True)
    stat = back.select(F.input_file_name().alias("file")).agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_pairs"))
    stat.coalesce(1).write.mode("overwrite").csv(f"{path}/stat", header=True)


def write_matches(predicted: DataFrame, path: str, label: str = "predicted") -> None:
    """Matches and rejections apart."""
    predicted.where(F.col(label) == 1).write.mode("overwrite").parquet(f"{path}/match_res")
    predicted.where(F.col(label) == 0).write.mode("overwrite").parquet(f"{path}/neg_match_res")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, value) and edges (src, dst) of the text format with ``v id value`` and ``e from to`` lines."""
    lines = spark.read.text(path)
    v = lines.where("value like 'v %'").select(F.regexp_extract("value", r"^v (\d+) ", 1).cast("long").alias("id"), F.regexp_extract("value", r"^v \d+ (.*)$", 1).alias("value"))
    e = lines.where(F.col("value").rlike(r"^e \d+ \d+$")).select(F.split("value", " ")[1].cast("long").alias("src"), F.split("value", " ")[2].cast("long").alias("dst"))
    return v, e


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices (id, value) and edges (src, dst; each once, the smaller id first) in the format that ``read_graph``
    reads, after a line with both counts."""
    v = vertices.select(F.lit(1).alias("part"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), F.concat_ws(" ", F.lit("v"), "id", "value").alias("value"))
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    e = e.select(F.lit(2).alias("part"), "x", "y", F.concat_ws(" ", F.lit("e"), "x", "y").alias("value"))
    head = v.unionByName(e).agg(F.count(F.when(F.col("part") == 1, 1)).alias("n"), F.count(F.when(F.col("part") == 2, 1)).alias("m"))
    head = head.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.concat_ws(" ", "n", "m").alias("value"))
    head.unionByName(v).unionByName(e).orderBy("part", "x", "y").select("value").write.mode("overwrite").text(path)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """A counted text file as one row of its lines after the first. Its records have no keys and their lengths stand inside
    them, so that a file is read as a whole: it must fit in a task. Tables of any size belong in Parquet."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    return whole.select(F.slice("lines", 2, F.size("lines")).alias("lines"))


def read_value_pairs(spark: SparkSession, path: str) -> DataFrame:
    """L and r from a counted file with a line for each side."""
    rows = _records(spark, path).select(F.posexplode("lines").alias("i", "value"))
    return rows.groupBy(F.floor(F.col("i") / 2).alias("k")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("value"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("value"))).alias("r")).select("l", "r")


def _numbers(line) -> F.Column:
    return F.transform(F.slice(F.split(line, " +"), F.lit(2), F.split(line, " +")[0].cast("int")), lambda x: x.cast("double"))


def read_value_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Value and vec from a counted file: a line with the value, one with the dimension and the numbers."""
    return read_value_pairs(spark, path).select(F.col("l").alias("value"), _numbers(F.col("r")).alias("vec"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Value and vecs (sorted) from a counted file: a line with the value, one with the number of words, one a word."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lines in batch.column("lines").to_pylist():
                out, at = [], 0
                while at + 1 < len(lines):
                    n = int(lines[at + 1])
                    vectors = [[float(x) for x in v.split()[1:]] for v in lines[at + 2 : at + 2 + n]]
                    out.append((lines[at], sorted(vectors)))
                    at += 2 + n
                yield pa.record_batch([pa.array([v for v, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.list_(pa.float64())))], ["value", "vecs"])

    return _records(spark, path).mapInArrow(run, "value string, vecs array<array<double>>")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_id and value from a counted file: a line with the group's number and size, then its values. Groups of one
    value are written without it and left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lines in batch.column("lines").to_pylist():
                out, at = [], 0
                while at < len(lines):
                    key, n = map(int, lines[at].split()[:2])
                    at += 1
                    if n > 1:
                        out += [(key, v) for v in lines[at : at + n]]
                        at += n
                yield pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.string())], ["group_id", "value"])

    return _records(spark, path).mapInArrow(run, "group_id long, value string")


def write_normalised(a: DataFrame, b: DataFrame | None, grouped: DataFrame, attr: str, path: str) -> None:
    """Both tables with the values of each group as one (V9), as CSV under normalized_A and normalized_B."""
    from pairsmith.operators import values

    for name, df in (("A", a), ("B", b)):
        if df is not None:
            write_csv(values.normalise_values(df, attr, grouped), f"{path}/normalized_{name}")

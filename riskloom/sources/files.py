"""Text formats of event logs, graphs and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _allow(spark: SparkSession, encoding: str) -> None:
    """Spark takes only the Unicode and ISO encodings unless told otherwise."""
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path, schema: T.StructType | str, encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with a header; the schema is given, so nothing is inferred. GBK and others by ``encoding``."""
    _allow(spark, encoding)
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    _allow(df.sparkSession, encoding)
    df.write.mode(mode).option("header", True).option("encoding", encoding).csv(path)


def read_embeddings(spark: SparkSession, path) -> DataFrame:
    """(id, vector) from word-vector text; the header line has two fields only."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("id"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vector"))


def embedding_columns(df: DataFrame, size: int, prefix: str = "f") -> DataFrame:
    return df.select("id", *(F.col("vector")[i].alias(f"{prefix}{i}") for i in range(size)))


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of id and numbers; the header with count and size is its own part, so it reads back with them."""
    line = F.concat_ws(" ", F.col("id").cast("string"), F.transform("vector", lambda x: x.cast("string")))
    head = df.agg(F.concat_ws(" ", F.count("*").cast("string"), F.max(F.size("vector")).cast("string")).alias("value"))
    head.unionByName(df.select(line.alias("value"))).write.mode(mode).text(path)


def read_edges(spark: SparkSession, path, undirected: bool = False) -> DataFrame:
    """(src, dst, weight) from lines of two or three fields; a missing weight is 1."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 2)
    edges = rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))
    if undirected:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return edges


def read_adjacency(spark: SparkSession, path, checked: bool = True) -> DataFrame:
    """(node, neighbours) from lines of a node and its neighbours; ``#`` starts
    a comment. Checked: neighbours are sorted, distinct, and not the node itself."""
    rows = spark.read.text(path).where(~F.startswith(F.ltrim("value"), F.lit("#")) & (F.trim("value") != ""))
    p = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long"))
    rows = rows.select(p.alias("p")).select(F.col("p")[0].alias("node"), F.slice("p", 2, F.size("p")).alias("neighbours"))
    if checked:
        rows = rows.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("neighbours")))).alias("neighbours"))
        rows = rows.withColumn("neighbours", F.array_remove("neighbours", F.col("node")))
    return rows


def read_matrix_graph(spark: SparkSession, path, variable: str = "network", undirected: bool = False) -> DataFrame:
    """(src, dst, weight) of the numeric matrix ``variable``, sparse or dense,
    of MATLAB level 5 files; every cell that is not zero is an edge, rows are
    sources, and numbers start at 0.  Files are read by the tasks, one file in
    one task; a file without that variable is an error."""
    from riskloom.sources.matlab import edge_batches

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    edges = rows.mapInPandas(edge_batches(variable), "src long, dst long, weight double")
    if undirected:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return edges


def read_walks(spark: SparkSession, paths) -> DataFrame:
    """(nodes) from walk files, one walk a line."""
    return spark.read.text(paths).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("nodes"))


def write_walks(walks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of text files for each pass."""
    line = F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ")
    walks.select("pass", line.alias("value")).write.mode(mode).partitionBy("pass").text(path)


def walks_written(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether the folder holds that many walks already, so they need not be made again."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).count() == expected
    except AnalysisException:
        return False


def fixed_lines(df: DataFrame, form: str, *columns: str) -> DataFrame:
    """Lines in a printf form, such as ``%d %d %f``."""
    return df.select(F.format_string(form, *columns).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Lines ``src dst {'weight': w}``."""
    return edges.select(F.format_string("%d %d {'weight': %s}", "src", "dst", F.col("weight").cast("string")).alias("value"))


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of the files in a folder and below, without their contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def line_counts(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"))


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """(word, n) by white space."""
    return df.select(F.explode(F.split(F.trim(text), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))

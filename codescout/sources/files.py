"""Readers and writers for query maps, code references, triplets and results.

JSON documents are read one per line by default, so large inputs split; with
``multi_line`` a whole file is one document. Every reader that lets later input win
orders rows by file, position in the file and row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.text import file_safe, strip_space, word_count

# Texts that stand for a missing value in CSV input.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TRIPLET_COLUMNS = ("specialty", "anchor", "positives", "negatives")
QUERY_MAP = "map<string,array<string>>"
LABEL_MAP = "map<string,map<string,array<string>>>"


def input_order() -> Column:
    """Position of a row in its input; use it straight after a file scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def _documents(spark: SparkSession, path: str | list[str], schema: str, multi_line: bool) -> DataFrame:
    text = spark.read.text(path, wholetext=multi_line)
    return text.select(input_order().alias("_order"), F.from_json("value", schema).alias("_map"))


def read_specialty_queries(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Documents of one specialty each, as (specialty, query) rows.

    Only the first key of a document counts, and a later document replaces an earlier
    one of the same specialty.
    """
    first = _documents(spark, path, QUERY_MAP, multi_line).select(
        "_order", F.get(F.map_entries("_map"), F.lit(0)).alias("_entry")
    )
    last = (
        first.filter(F.col("_entry").isNotNull())
        .groupBy(F.col("_entry")["key"].alias("specialty"))
        .agg(F.max_by(F.col("_entry")["value"], "_order").alias("_queries"))
    )
    return last.select("specialty", F.explode("_queries").alias("query"))


def read_query_map(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Maps of specialty to queries, as (specialty, query) rows."""
    entries = _documents(spark, path, QUERY_MAP, multi_line).select(F.explode("_map").alias("specialty", "_queries"))
    return entries.select("specialty", F.explode("_queries").alias("query"))


def merge_specialty_maps(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Maps of specialty to query to codes from several inputs; a later input wins per query."""
    merged = None
    for ordinal, path in enumerate(paths):
        entries = _documents(spark, path, LABEL_MAP, multi_line).select(
            F.lit(ordinal).alias("_input"), "_order", F.explode("_map").alias("specialty", "_labels")
        )
        rows = entries.select("_input", "_order", "specialty", F.explode("_labels").alias("query", "codes"))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged.groupBy("specialty", "query").agg(
        F.max_by("codes", F.struct("_input", "_order")).alias("codes")
    )


def _csv(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')


def na_to_null(column: Column) -> Column:
    return F.when(~column.isin(*NA_TOKENS), column)


def read_code_reference(
    spark: SparkSession, path: str | list[str], positions: tuple[int, int] = (13, 14), multi_line: bool = True
) -> DataFrame:
    """Codes and descriptions from a wide CSV, one description per code.

    The first column is an index and not counted in ``positions``. Repeated pairs are
    dropped; of the remaining pairs of a code the last one wins.
    """
    raw = _csv(spark, path, multi_line)
    code, description = (raw.columns[1 + p] for p in positions)
    pairs = (
        raw.select(
            na_to_null(F.col(f"`{code}`")).alias("code"),
            na_to_null(F.col(f"`{description}`")).alias("description"),
            input_order().alias("_order"),
        )
        .filter(F.col("code").isNotNull())
        .groupBy("code", "description")
        .agg(F.min("_order").alias("_order"))
    )
    return pairs.groupBy("code").agg(F.max_by("description", "_order").alias("description"))


def read_triplets(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Text triplets from CSV, without the leading index column or only the named columns."""
    raw = _csv(spark, path, multi_line)
    names = list(columns) if columns else raw.columns[1:]
    return raw.select(*[na_to_null(F.col(f"`{name}`")).alias(name) for name in names])


def read_triplets_limited(spark: SparkSession, path: str | list[str], n: int, multi_line: bool = True) -> DataFrame:
    """Up to n distinct complete triplets; repeats are removed over the whole input."""
    rows = read_triplets(spark, path, multi_line=multi_line).na.drop()
    return rows.select(*TRIPLET_COLUMNS[1:]).dropDuplicates().limit(n)


def read_keywords(spark: SparkSession, csv_path: str | list[str], json_path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Keywords of a CSV column followed by those of JSON string lists, with word counts."""
    listed = _csv(spark, csv_path, True).select(na_to_null(F.col("Keywords")).alias("final_keywords"))
    documents = spark.read.text(json_path, wholetext=multi_line)
    more = documents.select(F.explode(F.from_json("value", "array<string>")).alias("final_keywords"))
    both = listed.unionByName(more)
    return both.withColumn("sequence_length", word_count(F.col("final_keywords")))


def read_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Queries of a file: items of JSON lists, or trimmed lines that are not blank."""
    if path.endswith(".json"):
        documents = spark.read.text(path, wholetext=multi_line)
        return documents.select(F.explode(F.from_json("value", "array<string>")).alias("query"))
    lines = spark.read.text(path).select(strip_space(F.col("value")).alias("query"))
    return lines.filter(F.col("query") != "")


# --- embeddings ------------------------------------------------------------------------------


def save_embeddings(df: DataFrame, path: str, compression: str = "zstd", key: str = "key") -> None:
    """Write (key, embedding) as compressed parquet."""
    df.select(F.col(key).alias("key"), "embedding").write.mode("overwrite").parquet(path, compression=compression)


def load_embeddings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read embeddings; vectors of different dimension or a missing path are an error."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    sizes = df.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError(f"vectors differ in dimension: {sizes.low} to {sizes.high}")
    return df


# --- results ---------------------------------------------------------------------------------


def write_per_specialty(results: DataFrame, path: str) -> None:
    """JSON results in one folder per specialty; only folders with new results are replaced.

    Rows are rebalanced by specialty: small ones share a task and AQE splits a hot one
    over many.
    """
    named = results.withColumn("specialty", file_safe(F.col("specialty")))
    (
        named.hint("rebalance", F.col("specialty"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("specialty")
        .json(path)
    )


def combine_results(spark: SparkSession, path: str) -> DataFrame:
    """All results under a folder of :func:`write_per_specialty`; specialty from the folder."""
    schema = "query string, codes array<string>, specialty string"
    return spark.read.schema(schema).json(path).select("specialty", "query", "codes")


def write_sampling_outputs(plan: DataFrame, samples: DataFrame, plan_path: str, samples_path: str) -> None:
    """The sampling table as CSV and the sampled queries as JSON."""
    plan.write.mode("overwrite").csv(plan_path, header=True)
    samples.write.mode("overwrite").json(samples_path)


# --- JSON-safe columns -----------------------------------------------------------------------

_JSON_TYPES = (
    T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.NullType,
)


def _is_json_safe(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _is_json_safe(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _is_json_safe(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_is_json_safe(field.dataType) for field in kind)
    return isinstance(kind, _JSON_TYPES)


def _json_safe(column: Column, kind: T.DataType) -> Column:
    if _is_json_safe(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        values = F.transform_values(column, lambda _, v: _json_safe(v, kind.valueType))
        return F.transform_keys(values, lambda k, _: k.cast("string"))
    if isinstance(kind, T.StructType):
        fields = [_json_safe(column[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column.cast("string")


def json_safe(df: DataFrame) -> DataFrame:
    """Cast every value that JSON has no type for to text, at any depth."""
    return df.select(*[_json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def json_unsafe_columns(df: DataFrame) -> DataFrame:
    """Columns that :func:`json_safe` changes, with their types."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema if not _is_json_safe(f.dataType)]
    return df.sparkSession.createDataFrame(rows, "column string, type string")

"""Reading files, with the same five kinds of failure for every format."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..session import shared_folder

# File extensions and the format each one means.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


class IngestionError(Exception):
    """Any failure to read a table."""


class UnsupportedFileFormatError(IngestionError):
    """The extension names no known format."""


class DatasetNotFoundError(IngestionError, FileNotFoundError):
    """There is nothing at the path."""


class EmptyDatasetError(IngestionError):
    """No bytes, no rows or no columns."""


class CorruptDatasetError(IngestionError):
    """The content does not parse as its format."""


def detect_format(path: str) -> str:
    """Format by extension, ignoring case."""
    match = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    suffix = match.group(0).lower() if match else ""
    if suffix not in FORMATS:
        raise UnsupportedFileFormatError(
            f"unsupported extension '{suffix}' of {path}; supported: {', '.join(sorted(FORMATS))}")
    return FORMATS[suffix]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool = False) -> DataFrame:
    """Header row, inferred types unless given; ragged rows are errors.

    A file is split among tasks, so values must not hold line breaks unless ``multi_line`` says so.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool = False) -> DataFrame:
    """One record per line, or with ``multi_line`` an array of records, read by one task a file; nulls stay."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (reader if schema is None else reader.schema(schema)).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_size) of the files under a path, from the file index."""
    return (spark.read.format("binaryFile").load(path)
            .select(F.col("path").alias("file_path"), F.col("length").alias("file_size")))


def load(spark: SparkSession, path: str, fmt: str | None = None,
         schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a table and check that there is one: present, non-empty, parseable in every row.

    The check of a text file reads it once; types given by ``schema`` save the pass that infers them.
    ``multi_line``: CSV values with line breaks, JSON as an array of records.
    """
    fmt = fmt or detect_format(path)
    try:
        size = _files(spark, path).agg(F.sum("file_size")).first()[0]
    except AnalysisException as err:
        raise DatasetNotFoundError(f"nothing found at {path}") from err
    if not size:
        raise EmptyDatasetError(f"{path} has no bytes")
    try:
        if fmt == "csv":
            df = read_csv(spark, path, schema, multi_line)
        elif fmt == "json":
            df = read_json(spark, path, schema, multi_line)
        elif fmt == "parquet":
            df = read_parquet(spark, path)
        else:
            raise UnsupportedFileFormatError(f"unsupported format '{fmt}'")
        columns, empty = df.columns, df.isEmpty()
        if fmt != "parquet" and not empty:
            df.agg(*[F.count(col(c)) for c in columns]).first()        # every value is parsed; a broken row fails here
    except PySparkException as err:
        raise CorruptDatasetError(f"{path} does not parse as {fmt}: {err}") from err
    except Exception as err:
        if isinstance(err, IngestionError):
            raise
        raise CorruptDatasetError(f"{path} does not parse as {fmt}: {err}") from err
    if columns == ["_corrupt_record"]:
        raise CorruptDatasetError(f"{path} does not parse as {fmt}")
    if not columns:
        raise EmptyDatasetError(f"{path} has no columns")
    if empty:
        raise EmptyDatasetError(f"{path} has no rows")
    return df


def load_tolerant(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of CSV or JSON lines: what parses by ``schema``, and (file, record, reason) of what does not.

    The files are parsed once: rows and rejected records are written to the shared folder side by side, and each result
    reads its own side. A record is rejected if it has too few or too many values, a value that is not of its type, or
    is no JSON object. Where every record is rejected, the rows are empty.
    """
    fmt = fmt or detect_format(path)
    if fmt not in ("csv", "json"):
        raise UnsupportedFileFormatError(f"records of '{fmt}' cannot be rejected one by one")
    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    whole, record = T.StructType([*fields, T.StructField("__record", T.StringType())]), F.col("__record")
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__record")
    try:
        parsed = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    except AnalysisException as err:
        raise DatasetNotFoundError(f"nothing found at {path}") from err
    if fmt == "csv":
        texts = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))], T.StructField("more", T.StringType())])
        said = F.from_csv(record, texts.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
        text = [said[f"c{i}"] for i in range(len(fields))]
        shape = (F.when(said["more"].isNotNull(), F.lit("too many values"))
                 .when(F.size(F.split(F.regexp_replace(record, '"[^"]*"', ""), ",")) < len(fields), F.lit("too few values")))
    else:
        text = [F.get_json_object(record, "$['" + f.name.replace("'", "\\'") + "']") for f in fields]
        shape = F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT"), F.lit(False)), F.lit("no JSON object"))
    wrong = [F.when(t.isNotNull() & col(f.name).isNull(), F.lit(f"{f.name}: no {f.dataType.simpleString()}")) for f, t in zip(fields, text)]
    reason = F.coalesce(shape, F.nullif(F.concat_ws("; ", *wrong), F.lit("")), F.lit("does not parse"))
    judged = parsed.select(*[col(f.name) for f in fields], record, F.when(record.isNotNull(), reason).alias("__reason"),
                           F.col("_metadata.file_path").alias("__file"), record.isNotNull().alias("__rejected"))
    out = shared_folder(spark, "loaded")
    judged.write.partitionBy("__rejected").parquet(out)
    back = spark.read.schema(judged.schema).parquet(out)
    return (back.where("NOT __rejected").select(*[col(f.name) for f in fields]),
            back.where("__rejected").select(F.col("__file").alias("file"), record.alias("record"), F.col("__reason").alias("reason")))


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row about the files a table is read from: count, bytes, columns, row count, time."""
    files = (df.select("_metadata.file_path", "_metadata.file_size")
             .groupBy("file_path").agg(F.max("file_size").alias("file_size"), F.count("*").alias("rows")))
    return files.agg(
        F.min("file_path").alias("first_file"), F.count("*").alias("files"),
        F.sum("file_size").alias("file_size_bytes"), F.sum("rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"),
        F.current_timestamp().alias("ingested_at"))

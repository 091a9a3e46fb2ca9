"""Reading labelled tables: CSV and parquet scans, checks on arrival, previews."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TEXT_ENCODINGS = ("UTF-8", "GBK")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on the file system its scheme names?"""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    encoding: str = TEXT_ENCODINGS[0],
    quoted_line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header line. Without a schema the types cost one extra scan.

    Files with line breaks inside quotes cannot be split over tasks, so they must be asked for.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.option("multiLine", quoted_line_breaks).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or CSV by its file ending; NaN is read as missing."""
    if path.endswith((".csv", ".csv.gz")):
        return nan_as_null(read_csv(spark, path, schema))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_as_null(reader.parquet(path))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Averages skip null but not NaN, so NaN becomes null on arrival."""
    fractional = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in fractional})


def _undecodable(spark: SparkSession, path: str) -> bool:
    """Is there a line that is not UTF-8? The search stops at the first one."""
    return not spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).isEmpty()


def read_encoded_csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """CSV with a header line in an encoding that Spark's reader doesn't offer; types cost one extra scan.

    Lines are read as bytes, so files are split over tasks as usual, and decoded in Arrow batches. The encoding
    must not use the byte of a line feed inside characters, which holds for GBK and all that extend ASCII like it.
    A byte sequence that the encoding doesn't know fails the query.
    """
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([line.decode(encoding) for line in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([lines], names=["value"])

    lines = spark.read.text(path).select(F.col("value").cast("binary")).mapInArrow(decoded, "value string")
    texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", True)
    return DataFrame(reader._jreader.csv(texts), spark)


def read_checked_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV that must have a row and two columns; GBK is tried if the text is not UTF-8."""
    if not path_exists(spark, path) or spark.read.text(path).isEmpty():
        raise ValueError("the file is empty")
    if _undecodable(spark, path):
        df = nan_as_null(read_encoded_csv(spark, path, TEXT_ENCODINGS[1]))
    else:
        df = nan_as_null(read_csv(spark, path))
    if df.isEmpty():
        raise ValueError("the table has no rows")
    if len(df.columns) < 2:
        raise ValueError("the table needs at least one feature column and a target column")
    return df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The table and True, or an empty table of the schema and False if nothing is there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema), False
    return read_table(spark, path), True


def preview(df: DataFrame, row_id: str, rows: int = 8) -> DataFrame:
    """The first rows in ``row_id`` order with the table's row count beside them."""
    total = df.count()
    return df.orderBy(row_id).limit(rows).withColumn("row_count", F.lit(total).cast("long"))

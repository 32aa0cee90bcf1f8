"""Sources and sinks: the file formats that Spark knows, with schemas given or kept beside the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")
#: What a format needs so that a table comes back as it was written, nulls and line breaks included.
OPTIONS = {"csv": {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A table; formats without a schema of their own (JSON, CSV) should be given one, as guessing reads all data."""
    reader = spark.read.format(_known(kind)).options(**OPTIONS.get(kind, {}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes a table. With ``partition_by`` rows are dealt out by these columns first, so that a partition has few files."""
    rows = df.repartition(*partition_by) if partition_by else df
    rows.write.format(_known(kind)).options(**OPTIONS.get(kind, {})).partitionBy(*partition_by).mode(mode).save(path)


def save_table(df: DataFrame, name: str, bucket_by: tuple[str, ...] = (), buckets: int = 8, mode: str = "overwrite") -> None:
    """Writes a table of the catalog; buckets spare joins and aggregations on these columns their shuffle."""
    writer = df.write.mode(mode).format("parquet")
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer).saveAsTable(name)


def _known(kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    return kind

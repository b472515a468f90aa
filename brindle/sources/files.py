"""File sources and sinks: scans with pinned schemas, idempotent partition loads, exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIVOT_ROWS = ("Grand Total", "總計", "合計", "(blank)", "(空白)")


def parquet(spark: SparkSession, *globs: str, schema: str | None = None, by_name: bool = False) -> DataFrame:
    """Parquet by glob. ``schema`` pins the types, those of partition columns too; ``by_name`` unites files of different columns, missing ones null."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.option("mergeSchema", str(by_name).lower()).parquet(*globs)


def csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "utf-8", **options) -> DataFrame:
    """CSV with a header, all text unless a schema says otherwise. Charsets beyond the UTF family (big5, cp950) need
    spark.sql.legacy.javaCharsets, which is set for the session when asked for."""
    if not encoding.lower().startswith(("utf", "iso-8859-1", "us-ascii")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    r = spark.read.option("header", True).option("encoding", encoding).options(**options)
    return (r.schema(schema) if schema else r).csv(path)


def without_pivot_rows(df: DataFrame, first: str) -> tuple[DataFrame, list[str]]:
    """Rows of a pasted pivot table without its totals and blanks, and the names of helper columns without a header."""
    return df.where(F.col(first).isNull() | ~F.trim(first).isin(*PIVOT_ROWS)), [c for c in df.columns if c.startswith(("Unnamed", "_c"))]


def ingested(df: DataFrame) -> DataFrame:
    """Add when and from which file a row came."""
    return df.select("*", F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite the partitions that ``df`` holds and no others, so a load run again gives the same table. Rows are first brought together by
    partition, so each gets few files."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Fails if there is something already."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def append(df: DataFrame, path: str, daily: bool) -> None:
    """Appending isn't idempotent, so a daily load mustn't."""
    if daily:
        raise ValueError("a daily load overwrites its partitions; appending would double them when run again")
    df.write.mode("append").parquet(path)


def partition_advice(rows_gb: float, years: float) -> list[str]:
    """Partition columns that keep 100 MB a partition or more: none, by month or by day; never by hour."""
    for cols, parts in ((["year", "month", "day"], years * 365), (["year", "month"], years * 12), (["year"], years)):
        if rows_gb * 1000 / max(parts, 1) >= 100:
            return cols
    return []


def export_csv(df: DataFrame, path: str) -> int:
    """A small result as one CSV with a byte-order mark, for spreadsheets; gives its rows."""
    p = df.toPandas()
    p.to_csv(path, index=False, encoding="utf-8-sig")
    return len(p)


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """(rows, checksum) of a list, whatever the order of its rows: the digest of sums of row hashes."""
    c = [F.coalesce(F.col(x).cast("string"), F.lit("\\N")) for x in cols]
    h = F.sha2(F.concat_ws("|", *c), 256)
    part = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *part), 256).alias("checksum"))


def export_audience(df: DataFrame, path: str, must: list[str], expected: int) -> str:
    """Write an audience list that has its mandatory columns and the number of rows that was quoted; gives its fingerprint."""
    missing = [c for c in must if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    r = fingerprint(df, must).first()
    if r["rows"] != expected:
        raise ValueError(f"{r['rows']} rows, {expected} were quoted")
    write_new(df, path)
    return r["checksum"]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, pages):
        self.options, self.pages = options, pages

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.pages(partition.value, self.options.get("since"))


def api_source(name: str, schema_: str, pages) -> type[DataSource]:
    """A data source over a paged interface: ``pages(number, since)`` gives the rows of a page that changed after ``since``. Pages are read in
    parallel. Register it with spark.dataSource.register and keep ``since`` in the loader's watermark table."""

    class Api(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(self.options, pages)

    return Api

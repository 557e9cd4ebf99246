"""Landing-zone readers and panel writers.

Waves land as Parquet under ``<root>/fam/year=<y>``, supplements under ``<root>/wealth/year=<y>``
and index releases under ``<root>/ind*``. Tables that steer the work (crosswalks, code
hierarchies, price index, variable lists) land as CSV or Parquet.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.functions.na import to_number
from wavespan.operators.assemble import common_type
from wavespan.operators.recode import normalise_case
from wavespan.session import stored

MOST_TABLE_ROWS = 1_000_000


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob, sorted by name, on whatever file system the pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def family_waves(spark: SparkSession, root: str, years: Iterable[int]) -> dict[int, DataFrame]:
    """Household files of the given years; each wave keeps its own raw schema."""
    return {y: spark.read.parquet(f"{root}/fam/year={y}") for y in years}


def family_scan(spark: SparkSession, root: str, years: Iterable[int]) -> DataFrame | None:
    """The household files of the given years as one table with a column ``year``: one scan.

    A variable that several waves carry under one name takes the widest of its number types. Where
    a wave has text and another numbers there is no common table: None.
    """
    paths = [f"{root}/fam/year={y}" for y in years]
    reader = spark.read.option("basePath", f"{root}/fam")
    try:
        return reader.option("mergeSchema", True).parquet(*paths)
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    fields: dict[str, list] = {}
    for path in paths:
        for f in spark.read.parquet(path).schema:
            fields.setdefault(f.name.lower(), []).append(f)
    kinds = {}
    for name, found in fields.items():
        kinds[name] = common_type([f.dataType.simpleString() for f in found])
        if kinds[name] == "string" and any(f.dataType.simpleString() != "string" for f in found):
            return None
    schema = ", ".join(f"`{found[0].name}` {kinds[name]}" for name, found in fields.items())
    return reader.schema(f"{schema}, year int").parquet(*paths)


def wealth_waves(spark: SparkSession, root: str, years: Iterable[int]) -> dict[int, DataFrame]:
    """Supplements of the given years, where there is one."""
    landed = {p.rstrip("/").rsplit("year=", 1)[1]: p
              for p in matching_paths(spark, f"{root}/wealth/year=*")}
    return {y: spark.read.parquet(landed[str(y)]) for y in years if str(y) in landed}


def person_index(spark: SparkSession, root: str, pattern: str = "ind*") -> DataFrame:
    """The person index with upper-case names; of several releases the last by name counts."""
    releases = matching_paths(spark, f"{root}/{pattern}")
    if not releases:
        raise FileNotFoundError(f"no person index matches {root}/{pattern}")
    return normalise_case(spark.read.parquet(releases[-1]), upper=True)


def _csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_file_order(df: DataFrame, out: str = "ord") -> DataFrame:
    """Numbers the rows of a table read from files from 0, in file order: files by name, each from
    its first row to its last.

    A file may be read in blocks. The rows of a block are counted where they lie; a line for each
    block is summed up, and rows take their block's start plus their place in it. The numbered rows
    are kept once, so that count and place come from the same reading.
    """
    at = [F.col("_metadata.file_path").alias("__file"),
          F.col("_metadata.file_block_start").alias("__block"),
          F.monotonically_increasing_id().alias("__row")]
    rows = stored(df.select("*", *at))
    blocks = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"),
                                                   F.min("__row").alias("__first"))
    earlier = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(blocks.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))))
    place = F.col("__start") + F.col("__row") - F.col("__first")
    joined = rows.join(starts.drop("__n"), ["__file", "__block"])
    return joined.select(*df.columns, place.alias(out))


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Variable crosswalk: descriptive columns, then one ``Y<year>`` column per wave."""
    return with_file_order(_csv(spark, path))


def code_hierarchy(spark: SparkSession, path: str, key: str, two_digit: str,
                   one_digit: str) -> DataFrame:
    """3-digit codes with their 2- and 1-digit parents, which may be text or blank."""
    return _csv(spark, path, f"{key} INT, {two_digit} STRING, {one_digit} STRING")


def price_index(spark: SparkSession, path: str, date: str = "DATE",
                value: str = "value") -> DataFrame:
    """Yearly price index: (year, value)."""
    return _csv(spark, path).select(
        F.year(F.to_date(date)).alias("year"), to_number(value).alias("value"))


def census_crosswalk(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Census code crosswalk: picked and renamed columns plus the file order."""
    return with_file_order(_csv(spark, path)).select(
        *[F.col(f"`{old}`").alias(new) for old, new in names.items()], "ord")


def variable_list(spark: SparkSession, path: str) -> DataFrame:
    """Long variable list: (year, name, variable)."""
    return _csv(spark, path, "year INT, name STRING, variable STRING")


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write Parquet partitioned by year; big years are split over several tasks and files."""
    panel.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)


def write_bucketed(panel: DataFrame, table: str, buckets: int, path: str | None = None,
                   pid: str = "pid", year: str = "year") -> None:
    """Store a panel as a table bucketed by person and sorted by person and wave, a file a bucket.

    Whatever partitions by person alone (the career chain, joins of two such tables) then needs no
    exchange. Read it with ``spark.table``.
    """
    writer = panel.repartition(buckets, pid).write.mode("overwrite").bucketBy(buckets, pid).sortBy(pid, year)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_panel(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Read a written panel; a year list prunes partitions."""
    panel = spark.read.parquet(path)
    return panel if years is None else panel.filter(F.col("year").isin(*years))


def write_table(table: DataFrame, path: str, mode: str = "overwrite",
                max_rows: int = MOST_TABLE_ROWS) -> None:
    """Write a small result table as one CSV file with a header; a large one raises."""
    table = stored(table)
    if table.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows for one file")
    table.coalesce(1).write.mode(mode).option("header", True).csv(path)

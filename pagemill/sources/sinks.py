"""Sinks: CSV in the two house styles, workbooks, one folder a group, reports, state and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import versions
from pagemill.sources.sheets import write_workbook


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by '; ', for formats without them."""
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    flat(df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, lines ended by CR LF."""
    rows = flat(df)
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_by_group(df: DataFrame, path: str, group: str) -> None:
    """One folder a group; a group's rows come from several tasks, so a large group isn't one task's."""
    flat(df).write.mode("overwrite").partitionBy(group).option("header", True).csv(path)


def workbook(sheets: dict[str, DataFrame], most_rows: int = 100_000) -> bytes:
    """A workbook of small result tables. A table of more than ``most_rows`` rows is refused; it belongs in CSV files."""
    out = {}
    for name, df in sheets.items():
        rows = flat(df).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        out[name] = [df.columns, *map(tuple, rows)]
    return write_workbook(out)


def markdown_lines(df: DataFrame, group: str, line: F.Column) -> DataFrame:
    """A report as text lines: a heading for each group, then its lines in order."""
    rows = df.select(F.col(group).alias("g"), line.alias("value"))
    heads = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.lit(0).alias("o"), F.concat(F.lit("## "), F.col("g"), F.lit(" ("), F.col("n"), F.lit(")")).alias("value"))
    return heads.union(rows.select("g", F.lit(1), F.concat(F.lit("- "), "value"))).orderBy("g", "o", "value")


def write_state(df: DataFrame, path: str) -> int:
    """State is replaced as a whole (see versions): a write that fails leaves what was there."""
    done = versions.write_version(df, path)
    versions.vacuum(df.sparkSession, path)
    return done


def audit(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, as JSON."""
    spark = next(iter(counts.values())).sparkSession
    return spark.createDataFrame([(k, v.count()) for k, v in counts.items()], "name string, n long").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n"))))).alias("audit")
    )


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file (a workbook) into a folder that driver and executors share, by any file system that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_split(df: DataFrame, path: str, confirmed: F.Column) -> None:
    """Confirmed rows and those to review in folders of their own, all columns quoted; null counts as to review."""
    met = F.coalesce(confirmed, F.lit(False))
    write_quoted_csv(df.filter(met), f"{path}/verified")
    write_quoted_csv(df.filter(~met), f"{path}/review")


def write_coverage(df: DataFrame, path: str, checked: F.Column) -> None:
    """A coverage export, each row stamped with the time of its check."""
    write_quoted_csv(df.withColumn("last_checked", F.date_format(checked, "yyyy-MM-dd'T'HH:mm:ss'Z'")), path)


def restore(snapshot: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The present rows and those of the snapshot whose key isn't there: restoring skips duplicates."""
    return present.unionByName(snapshot.join(present.select(key), key, "left_anti").dropDuplicates([key]))

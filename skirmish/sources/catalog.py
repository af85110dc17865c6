"""Snapshots, and their publication as tables with a manifest."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that a snapshot may hold, whether it must, and the columns that its files are sorted by.
TABLES = {
    "canonical_events": (True, ["event_date"]), "canonical_fights": (True, ["event_date", "fighter_a"]), "canonical_rounds": (False, ["fight_url"]), "canonical_fighters": (False, ["fighter"]),
    "ratings_current": (True, ["fighter"]), "ratings_history": (True, ["fighter", "event_date"]), "ratings_history_whr": (False, ["fighter", "event_date"]), "odds_lines": (False, ["fight_url"]),
    "performance_appearances": (False, ["fighter"]), "integrity_appearances": (False, ["fighter"]), "division_resume": (False, ["division", "fighter"]), "calibration_residuals": (False, ["segment_type"]),
    "sleeve_attribution": (False, ["fighter"]), "division_entropy": (False, ["year", "division"]),
}
DATE_COLUMNS = ("event_date", "last_event_date", "dob")


def _list(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def snapshots(spark: SparkSession, root: str, holding: str = "canonical_fights.parquet") -> list[str]:
    """Dated folders that hold a table, the newest last."""
    return [n for n in _list(spark, root) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n) and holding in _list(spark, f"{root}/{n}")]


def latest(spark: SparkSession, root: str) -> str | None:
    found = snapshots(spark, root)
    return found[-1] if found else None


def previous(spark: SparkSession, root: str, date: str) -> str | None:
    found = [n for n in snapshots(spark, root, "ratings_current.parquet") if n < date]
    return found[-1] if found else None


def first_complete(spark: SparkSession, folders: list[str], files: list[str]) -> str:
    """The first folder that has all files, else the first."""
    return next((f for f in folders if set(files) <= set(_list(spark, f))), folders[0])


def load(spark: SparkSession, folder: str, register: bool = True) -> dict[str, DataFrame]:
    """All known tables of a snapshot, as views too."""
    out = {}
    for file in _list(spark, folder):
        name = file.removesuffix(".parquet")
        if file.endswith(".parquet") and name in TABLES:
            out[name] = spark.read.parquet(f"{folder}/{file}")
            if register:
                out[name].createOrReplaceTempView(name)
    return out


def date_range(df: DataFrame) -> DataFrame:
    column = next((c for c in DATE_COLUMNS if c in df.columns), None)
    if column is None:
        return df.sparkSession.createDataFrame([(None, None)], "min_date date, max_date date")
    return df.agg(F.min(F.to_date(column)).alias("min_date"), F.max(F.to_date(column)).alias("max_date"))


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, competitors and dates of every table: one small aggregate each, in one union."""
    parts = []
    for name, df in sorted(tables.items()):
        column = next((c for c in DATE_COLUMNS if c in df.columns), None)
        date = F.to_date(column) if column else F.lit(None).cast("date")
        people = F.count_distinct("fighter") if "fighter" in df.columns else F.lit(None).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), people.alias("n_fighters"), F.min(date).alias("min_date"), F.max(date).alias("max_date")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_fighters", "min_date", "max_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gaps(spark: SparkSession, loaded: list[str]) -> DataFrame:
    """Known tables that aren't there, and whether they must be."""
    known = spark.createDataFrame([(n, must) for n, (must, _) in TABLES.items()], "table_name string, required boolean")
    have = spark.createDataFrame([(n,) for n in loaded], "table_name string")
    return known.join(have, "table_name", "left_anti").withColumn("gap", F.when(F.col("required"), "missing_required").otherwise("missing_optional"))


def publish(spark: SparkSession, folder: str, database: str) -> DataFrame:
    """A snapshot as tables of a database, sorted where an index would stand, with manifest and gaps; returns the manifest."""
    tables = load(spark, folder, register=False)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        keys = [k for k in TABLES[name][1] if k in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").saveAsTable(f"{database}.{name}")
    stored = {n: spark.table(f"{database}.{n}") for n in tables}
    notes = spark.createDataFrame([(n, json.dumps(df.columns), ",".join(TABLES[n][1])) for n, df in stored.items()], "table_name string, columns_json string, sorted_by string")
    manifest = coverage(stored).join(notes, "table_name")
    manifest.write.mode("overwrite").saveAsTable(f"{database}.source_manifest")
    gaps(spark, list(tables)).write.mode("overwrite").saveAsTable(f"{database}.source_gaps")
    return spark.table(f"{database}.source_manifest")


def listed(spark: SparkSession, database: str) -> list[str]:
    """Tables of a database."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of the tables, with its place and type."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, column, kind) for name, df in sorted(tables.items()) for i, (column, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, type string")


def sorted_count(spark: SparkSession, database: str) -> int:
    """Columns that a published database's tables are sorted by, which stand for its indexes."""
    return spark.table(f"{database}.source_manifest").agg(F.sum(F.size(F.split("sorted_by", ",")))).first()[0] or 0


def modified(spark: SparkSession, path: str) -> DataFrame:
    """When each file of a table was last written, in UTC."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")).groupBy("file").agg(F.date_format(F.to_utc_timestamp(F.max("at"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


def load_database(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """All known tables of a published database."""
    return {name: spark.table(f"{database}.{name}") for name in listed(spark, database) if name in TABLES}


def load_any(spark: SparkSession, folder: str, database: str | None = None, prefer_database: bool = False) -> dict[str, DataFrame]:
    """A published database where it is wanted and holds the tables that must be, else the snapshot's files."""
    if prefer_database and database and spark.catalog.databaseExists(database):
        found = load_database(spark, database)
        if {n for n, (must, _) in TABLES.items() if must} <= set(found):
            return found
    return load(spark, folder, register=False)


def rendered(df: DataFrame) -> DataFrame:
    """Values as a plain store takes them: dates and times as ISO text, nested ones as JSON, flags as 0 and 1."""
    def value(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "date" or kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(c).alias(name)
        return c.cast("int").alias(name) if kind == "boolean" else c

    return df.select(*[value(n, k) for n, k in df.dtypes])


def copied(spark: SparkSession, source: str, target: str, files: list[str]) -> list[str]:
    """Copy the files that are there, on any file systems that Spark knows; returns their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for name in files:
        a, b = jvm.org.apache.hadoop.fs.Path(f"{source}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        if a.getFileSystem(conf).exists(a):
            jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
            done.append(name)
    return done


def changelog_entry(date: str, counts: dict[str, int], old: DataFrame | None, new: DataFrame, rating: str = "mu") -> str:
    """A run's summary as Markdown: counts, and how many competitors came, and moved by how much at the median and most."""
    lines = [f"## {date}", "", *[f"- {name}: {n:,}" for name, n in counts.items()]]
    if old is not None:
        both = new.select("fighter", F.col(rating).alias("b")).join(old.select("fighter", F.col(rating).alias("a")), "fighter", "left")
        row = both.agg(F.count_if(F.col("a").isNull()).alias("came"), F.median(F.abs(F.col("b") - F.col("a"))).alias("mid"), F.max(F.abs(F.col("b") - F.col("a"))).alias("most")).first()
        lines += [f"- new competitors: {row.came:,}", f"- rating change: median {row.mid or 0:.1f}, most {row.most or 0:.1f}"]
    return "\n".join([*lines, ""])


def append_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text at the end of a file on any file system that Spark knows; a file that isn't there begins with it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = "\n".join(r.value for r in spark.read.text(path).collect()) + "\n" if fs.exists(target) else ""  # a log's lines
    out = fs.create(target, True)
    out.write(bytearray((before + text).encode()))
    out.close()

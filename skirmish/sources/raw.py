"""Raw files to tables and tables to files: CSV exports, odds, aliases, curated findings, ranking pages, published notes."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean as c
from ..functions.odds import american_to_decimal, enriched
from .staging import cut

#: The files of a raw export and the columns of each.
RAW_FILES = {
    "events": ("ufc_event_details.csv", "EVENT,URL,DATE,LOCATION"),
    "results": ("ufc_fight_results.csv", "EVENT,BOUT,OUTCOME,WEIGHTCLASS,METHOD,ROUND,TIME,TIME FORMAT,REFEREE,DETAILS,URL"),
    "stats": ("ufc_fight_stats.csv", "EVENT,BOUT,ROUND,FIGHTER,KD,SIG.STR.,SIG.STR. %,TOTAL STR.,TD,TD %,SUB.ATT,REV.,CTRL,HEAD,BODY,LEG,DISTANCE,CLINCH,GROUND"),
    "details": ("ufc_fighter_details.csv", "FIRST,LAST,NICKNAME,URL"),
    "tale": ("ufc_fighter_tott.csv", "FIGHTER,HEIGHT,WEIGHT,REACH,STANCE,DOB,URL"),
}


def csv(spark: SparkSession, path: str, columns: str, sep: str = ",") -> DataFrame:
    """A CSV file with declared columns, all texts, stripped: nothing is inferred, so nothing is read twice."""
    schema = ", ".join(f"`{x}` string" for x in columns.split(","))
    return c.stripped(spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"'))


def raw_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: csv(spark, f"{folder}/{file}", columns) for name, (file, columns) in RAW_FILES.items()}


def build_snapshot(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Clean tables of a raw export as Parquet, with the excluded bouts apart; counts by table and by reason, from one aggregate."""
    raw = raw_export(spark, folder)
    events = raw["events"].select(F.col("EVENT").alias("event_name"), F.col("URL").alias("event_url"), c.date_of(F.col("DATE"), "MMMM d, yyyy").alias("event_date"), F.col("LOCATION").alias("event_location"))
    bouts = c.integrity_flags(c.clean_bouts(raw["results"], events))
    early = F.coalesce(F.col("event_date") < c.ERA_START, F.lit(True))
    bouts = bouts.withColumn("exclusion_reason", F.when(early, "pre_unified_rules").otherwise(F.col("exclusion_reason"))).withColumn("is_excluded", F.col("exclusion_reason").isNotNull())
    rounds = c.clean_rounds(raw["stats"], bouts)
    tables = {
        "canonical_events": events, "canonical_fights": bouts.where("not is_excluded"), "excluded_fights": bouts.where("is_excluded"),
        "canonical_rounds": rounds.join(bouts.where("not is_excluded").select("fight_url"), "fight_url", "left_semi"), "canonical_fighters": c.clean_fighters(raw["tale"], raw["details"]),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    counts = spark.read.parquet(f"{out}/canonical_fights.parquet", f"{out}/excluded_fights.parquet").groupBy(F.coalesce("exclusion_reason", F.lit("rated")).alias("reason")).count()
    return {r.reason: r["count"] for r in counts.collect()}  # a row for each reason


def snake_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"[^0-9a-z]+", "_", n.strip().lower()).strip("_") for n in df.columns])


def day_first(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, c.date_of(F.col(column), "d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd"))


def odds_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vendor odds (R_fighter, B_fighter, R_odds, B_odds, date), complete rows alone, with their pair key."""
    rows = spark.read.csv(path, header=True).select("R_fighter", "B_fighter", F.col("R_odds").try_cast("double").alias("R_odds"), F.col("B_odds").try_cast("double").alias("B_odds"), c.date_of(F.col("date"), "yyyy-MM-dd", "M/d/yyyy").alias("odds_date"))
    return rows.dropna().withColumn("pair_key", c.pair_key(F.lower(c.strip(F.col("R_fighter"))), F.lower(c.strip(F.col("B_fighter")))))


def matched_odds(bouts: DataFrame, vendor: DataFrame, days: int = 2) -> DataFrame:
    """Vendor rows of the same two names within some days of each bout, the nearest one, turned to the bout's sides."""
    a = F.lower(c.strip(F.col("fighter_a")))
    keyed = bouts.select("bout_id", "event_date", "fighter_a", "fighter_b", a.alias("_a"), c.pair_key(a, F.lower(c.strip(F.col("fighter_b")))).alias("pair_key"))
    near = keyed.join(vendor, "pair_key").withColumn("date_diff", F.abs(F.datediff("event_date", "odds_date"))).where(F.col("date_diff") <= days)
    best = near.withColumn("_k", F.row_number().over(W.partitionBy("bout_id").orderBy("date_diff", "odds_date", "R_odds"))).where("_k = 1")
    red = F.lower(c.strip(F.col("R_fighter"))) == F.col("_a")
    out = best.select("bout_id", "fighter_a", "fighter_b", "date_diff", F.when(red, F.col("R_odds")).otherwise(F.col("B_odds")).alias("american_odds_a"), F.when(red, F.col("B_odds")).otherwise(F.col("R_odds")).alias("american_odds_b"))
    return out.withColumns({f"decimal_odds_{s}": american_to_decimal(F.col(f"american_odds_{s}")) for s in "ab"})


def upserted(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All new rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def ingest_odds(bouts: DataFrame, vendor: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = matched_odds(bouts, vendor).drop("date_diff")
    return enriched(rows if existing is None else upserted(rows, existing.select(rows.columns), "bout_id"))


#: Columns and types of raw odds.
ODDS_SCHEMA = "bout_id long, fighter_a string, fighter_b string, american_odds_a double, american_odds_b double, decimal_odds_a double, decimal_odds_b double"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def has_odds(spark: SparkSession, snapshot: str) -> bool:
    return _there(spark, f"{snapshot}/odds_lines.parquet")


def empty_odds(spark: SparkSession) -> DataFrame:
    return enriched(spark.createDataFrame([], ODDS_SCHEMA))


def odds_lines(spark: SparkSession, snapshot: str) -> DataFrame:
    """A snapshot's odds with their probabilities; a typed empty table where it has none."""
    return enriched(spark.read.parquet(f"{snapshot}/odds_lines.parquet")) if has_odds(spark, snapshot) else empty_odds(spark)


def write_odds(bouts: DataFrame, vendor: DataFrame, snapshot: str) -> dict[str, int]:
    """Match vendor odds, put them into a snapshot before older ones of other bouts, and count rows by quality."""
    spark = bouts.sparkSession
    columns = [c.split()[0] for c in ODDS_SCHEMA.split(", ")]
    new = matched_odds(bouts, vendor).select(*columns)
    if has_odds(spark, snapshot):
        new = upserted(new, cut(spark.read.parquet(f"{snapshot}/odds_lines.parquet").select(*columns), "odds"), "bout_id")
    new.write.mode("overwrite").parquet(f"{snapshot}/odds_lines.parquet")
    counts = odds_lines(spark, snapshot).groupBy("odds_data_quality").count().collect()  # a row for each quality
    return {r.odds_data_quality: r["count"] for r in counts}


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Other spellings of names (alias, fighter) from a CSV; an empty table where there is none."""
    if not _there(spark, path):
        return spark.createDataFrame([], "alias string, fighter string")
    return spark.read.csv(path, header=True).select(F.trim("alias").alias("alias"), F.trim("fighter").alias("fighter")).where("alias <> '' and fighter <> ''")


def lab_snapshot(spark: SparkSession, folder: str, out: str, files: dict[str, str | None]) -> dict[str, dict]:
    """CSVs (name to their date column) as Parquet with clean headers; returns rows and dates of each."""
    notes = {}
    for name, date in files.items():
        rows = snake_headers(spark.read.csv(f"{folder}/{name}.csv", header=True))
        rows = day_first(rows, date) if date else rows
        rows.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        day = F.col(date) if date else F.lit(None).cast("date")
        row = spark.read.parquet(f"{out}/{name}.parquet").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("a"), F.max(day).alias("b")).first()
        notes[name] = {"rows": row.n, "min_date": str(row.a) if row.a else None, "max_date": str(row.b) if row.b else None}
    return notes


def curated_findings(spark: SparkSession, path: str) -> DataFrame:
    if not _there(spark, path):
        return spark.createDataFrame([], "event_date date, event_name string, fighter string, substance string")
    rows = spark.read.csv(path, header=True)
    missing = {"event_date", "event_name", "fighter", "substance"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return rows.withColumn("event_date", F.to_date("event_date"))


class _Cells(HTMLParser):
    """Tables of a page as rows of cells: text, and the links in it."""

    def __init__(self):
        super().__init__()
        self.tables: list[tuple[str, list]] = []
        self._open: list[int] = []
        self._cell = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.tables.append((attrs.get("class") or "", []))
            self._open.append(len(self.tables) - 1)
        elif tag == "tr" and self._open:
            self.tables[self._open[-1]][1].append([])
        elif tag in ("td", "th") and self._open and self.tables[self._open[-1]][1]:
            self._cell = {"text": [], "links": [], "kind": tag}
            self.tables[self._open[-1]][1][-1].append(self._cell)
        elif tag == "a" and self._cell is not None:
            self._cell["links"].append([attrs.get("href") or "", []])

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self._open.pop()
        elif tag in ("td", "th"):
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None and data.strip():
            self._cell["text"].append(data.strip())
            if self._cell["links"]:
                self._cell["links"][-1][1].append(data.strip())


def _tables(html: str | None) -> list[tuple[str, list]]:
    parser = _Cells()
    parser.feed(html or "")
    return parser.tables


def _text(cell) -> str:
    return " ".join(cell["text"])


@F.udtf(returnType="rank int, fighter string, age int, record string, points double, profile_url string, last_fight_text string, next_fight_text string")
class ParseRankings:
    """Rows of a ranking page's table, in its narrow layout (four cells) or its wide one (six and more)."""

    def eval(self, html: str):
        table = next((rows for name, rows in _tables(html) if "tblRank" in name.split()), [])
        for row in table:
            cells = [x for x in row if x["kind"] == "td"]
            if len(cells) < 4 or not _text(cells[0]).isdigit():
                continue
            at = (3, 4, 5) if len(cells) >= 6 else (1, 2, 3)
            link = next((x for cell in cells for x in cell["links"] if "fighter-profile" in x[0]), None)
            name = " ".join((" ".join(link[1]) if link else _text(cells[at[0]])).split())
            aged = re.fullmatch(r"(.+?)\s+\((\d+)\)", name)
            points = _text(cells[at[2]])
            last, nxt = (_text(cells[k]).replace(f"{w} Fight:", "").strip() if len(cells) > k else None for k, w in ((6, "Last"), (7, "Next")))
            yield int(_text(cells[0])), aged[1] if aged else name, int(aged[2]) if aged else None, _text(cells[at[1]]), float(points) if re.fullmatch(r"-?\d+(\.\d+)?", points) else None, link[0] if link else None, last, nxt


@F.udtf(returnType="result string, opponent string, event_name string, event_date_text string, method_raw string, end_round int, end_time_seconds int")
class ParseHistory:
    """Bouts of a competitor's page: the table whose head names a result and a method."""

    def eval(self, html: str):
        for _, rows in _tables(html):
            head = [_text(x) for x in rows[0]] if rows else []
            if "Result" not in head or not any("Method" in h for h in head):
                continue
            for row in rows[1:]:
                if len(row) < 6:
                    continue
                result, opponent, when = _text(row[0]).lower(), _text(row[1]), _text(row[2])
                if not opponent or result not in ("win", "loss", "draw", "nc", "no contest"):
                    continue
                date = re.search(r"([A-Z][a-z]{2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", when)
                linked = " ".join(row[2]["links"][0][1]) if row[2]["links"] else ""
                name = linked or (when.replace(date[0], "").strip(" -") if date else when)
                method = re.sub(r"(?i)\s*view play-by-play\s*", "", _text(row[3])).strip()
                clock = re.fullmatch(r"(\d+):(\d+)", _text(row[5]))
                yield (
                    "nc" if result.startswith("n") else result, opponent, name or None, f"{date[1]} {date[2]} {date[3]}" if date else None, method,
                    int(_text(row[4])) if _text(row[4]).isdigit() else None, int(clock[1]) * 60 + int(clock[2]) if clock else None,
                )
            return


def rankings(pages: DataFrame) -> DataFrame:
    """Pages (division, html) to ranking rows."""
    return pages.lateralJoin(ParseRankings(F.col("html").outer())).drop("html")


def histories(pages: DataFrame) -> DataFrame:
    """Pages (fighter, html) to bouts with dates and method classes."""
    rows = pages.lateralJoin(ParseHistory(F.col("html").outer())).drop("html")
    return rows.withColumns({"event_date": c.date_of(F.col("event_date_text"), "MMM d yyyy"), "method_class": c.crossing_method(F.col("method_raw")), "org": c.organisation(F.col("event_name"))}).drop("event_date_text")


def crossing_bouts(history: DataFrame, known: DataFrame, orgs: tuple[str, ...] = ("PRIDE", "Strikeforce", "WEC")) -> DataFrame:
    """One bout for each key among some organisations' histories, decided ones first, with a competitor that is known."""
    rows = history.where(F.col("org").isin(*orgs) & F.col("event_date").isNotNull() & (F.col("event_date") >= c.ERA_START))
    rows = rows.withColumn("bout_key", c.bout_key(F.col("event_date"), F.col("fighter"), F.col("opponent")))
    best = rows.withColumn("_k", F.row_number().over(W.partitionBy("bout_key").orderBy(F.col("result").isin("win", "loss").desc(), "fighter"))).where("_k = 1")
    won = F.col("result") != "loss"
    a, b = F.when(won, F.col("fighter")).otherwise(F.col("opponent")), F.when(won, F.col("opponent")).otherwise(F.col("fighter"))
    out = best.select("bout_key", "event_date", "event_name", "org", a.alias("fighter_a"), b.alias("fighter_b"), F.when(F.col("result").isin("win", "loss"), a).alias("winner"), (F.col("result") == "draw").alias("is_draw"), (F.col("result") == "nc").alias("is_nc"), "method_class", "end_round", "end_time_seconds")
    near = out.select("bout_key", F.explode(F.array("fighter_a", "fighter_b")).alias("fighter")).join(known.select("fighter"), "fighter", "left_semi").select("bout_key").distinct()
    return out.join(near, "bout_key", "left_semi")


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of pipe tables in a Markdown text, with the section and subsection they stand under."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    w = W.partitionBy(F.lit(0)).orderBy("line").rowsBetween(W.unboundedPreceding, 0)  # one document's lines
    head = F.last(F.when(F.col("text").startswith("## "), F.struct("line", F.substring("text", 4, 400).alias("name"))), True).over(w)
    sub = F.last(F.when(F.col("text").startswith("### "), F.struct("line", F.substring("text", 5, 400).alias("name"))), True).over(w)
    rows = lines.select("line", "text", head.alias("_h"), sub.alias("_s")).where("text like '|%' and not text rlike '^[|: -]+$'")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select("line", F.col("_h.name").alias("section"), F.when(F.col("_s.line") > F.col("_h.line"), F.col("_s.name")).alias("subsection"), cells.alias("cells"))


def schema_note(df: DataFrame, keys: list[str], grain: str) -> str:
    """A table's schema as JSON, for a file beside it."""
    return json.dumps({"primary_key": keys, "grain": grain, "columns": [{"name": n, "type": t} for n, t in df.dtypes]}, indent=2)

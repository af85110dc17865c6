"""URL filters from association rules.

Hand-written rules judge some addresses. Those are the labelled transactions: FP-growth mines the token combinations
that are frequent among them, and the combinations of host and path tokens that lead to `block` often enough are kept, unless
a part of one does so as surely; tokens that nearly all addresses have are no part of a rule. The rest of the addresses is judged by the mined rules, which are found through an inverted index:
each rule hangs on its rarest token, and only rules of an address's own tokens are looked at.

Edge cases: a null address, or one without `://`, has an empty host and path, fits no rule and is allowed unless a
mined rule says otherwise; rows repeat as they are; an empty table, or one without labels, mines nothing and allows
all; columns other than the id and the address are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

#: Fixed values: (verdict, host, path); a host stands for its subdomains too.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Share of the labelled addresses that must hold a combination; share of those with it that must be blocked.
SUPPORT, CONFIDENCE = 0.005, 0.85
#: Addresses that a combination must have in any case; how much oftener than the rest those with it must be blocked.
LEAST, LIFT = 8, 1.1
#: A token of more than this share of the labelled addresses says nothing about one.
COMMON = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of an address: labels of the host, segments of the path with their depth, numbers alike."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    top = F.array(F.concat(F.lit("top:"), F.element_at(F.split(host, r"\."), -1)))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(
        segments,
        lambda x, i: F.concat(
            F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(F.lower(x), r"\d+", "#")
        ),
    )
    return F.array_distinct(F.concat(labels, top, shaped))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, support, and the rarest token) from rows (tokens, verdict), by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    nothing = "tokens array<string>, confidence double, support double, token string"
    many = labelled.count()
    if not many:
        return spark.createDataFrame([], nothing)
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST / many)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent")[0] == "verdict:block") & (F.col("lift") >= LIFT))
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    common = single.where(F.col("freq") > COMMON * many).agg(F.collect_list("token").alias("common"))
    rules = rules.crossJoin(F.broadcast(common)).where(~F.arrays_overlap("antecedent", "common"))  # one row, of fewer tokens than an address can have
    rules = rules.where(F.exists("antecedent", lambda x: x.rlike("^(h|top):")) & F.exists("antecedent", lambda x: x.rlike(r"^p\d+:")))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith("verdict:"))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    # a rule goes when a part of it is as sure: the parts are looked up through their own tokens
    rarest = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(single, "token")
    whole = stored(rarest.groupBy("tokens", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("token")), "url-rules")
    parts = whole.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), "token")
    beaten = (
        whole.select("tokens", "confidence", F.explode("tokens").alias("token"))
        .join(parts, "token")
        .where("size(part) < size(tokens) and size(array_except(part, tokens)) = 0 and part_confidence >= confidence")
        .select("tokens")
        .distinct()
    )
    return whole.join(beaten, "tokens", "left_anti")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict and, where a mined rule decided, its confidence."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("row", "id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(rows.select("row", "id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), tokens_of(F.col("host"), F.col("path")).alias("tokens")), "url-rows")
    found = mined(rows.where("by_rule is not null").select("tokens", F.col("by_rule").alias("verdict")))
    index = found.select(F.col("tokens").alias("needed"), "confidence", "token")
    hits = (
        rows.where("by_rule is null")
        .select("row", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where("size(array_except(needed, tokens)) = 0")
        .groupBy("row")
        .agg(F.max("confidence").alias("confidence"))
    )
    verdict = F.coalesce("by_rule", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.join(hits, "row", "left").select("id", "host", "path", "rule", verdict.alias("verdict"), "confidence")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")

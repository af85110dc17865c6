"""Parsing and cleaning of raw bout records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stripped(df: DataFrame) -> DataFrame:
    return df.select(*[strip(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern, null where it doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def number(c: Column, pattern: str, group: int = 1, kind: str = "int") -> Column:
    return extracted(c, pattern, group).try_cast(kind)


def split_pair(c: Column, mark: str) -> tuple[Column, Column]:
    """Both sides of a text that holds the mark once, else nulls."""
    parts = F.split(c, mark)
    ok = F.size(parts) == 2
    return F.when(ok, strip(parts[0])), F.when(ok, strip(parts[1]))


def bout_sides(c: Column) -> tuple[Column, Column]:
    return split_pair(c, r" vs\. ")


def outcomes(c: Column) -> tuple[Column, Column]:
    a, b = split_pair(c, "/")
    return F.upper(a), F.upper(b)


#: Method prefixes and the class they stand for, in order; whole names after them.
METHOD_PREFIXES = (
    ("KO/TKO", "KO/TKO"), ("TKO", "KO/TKO"), ("Submission", "Submission"), ("Decision - Unanimous", "Decision - Unanimous"),
    ("Decision - Majority", "Decision - Majority"), ("Decision - Split", "Decision - Split"), ("Could Not Continue", "Could Not Continue"),
)
METHOD_NAMES = {"SUB": "Submission", "CNC": "Could Not Continue"}
METHOD_SCORES = {"KO/TKO": 1.0, "Submission": 1.0, "Decision - Unanimous": 0.95, "Decision - Majority": 0.90, "Decision - Split": 0.90, "DQ": 0.85}


def method_class(c: Column) -> Column:
    """Class of a method; one that isn't known stays as it is."""
    s = strip(c)
    out = s
    for name, label in METHOD_NAMES.items():
        out = F.when(s == name, label).otherwise(out)
    for prefix, label in reversed(METHOD_PREFIXES):
        out = F.when(s.startswith(prefix), label).otherwise(out)
    return out


def lookup(c: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def method_score(c: Column) -> Column:
    return lookup(c, METHOD_SCORES)


def of_pair(c: Column) -> tuple[Column, Column]:
    """`5 of 11` as two numbers."""
    p = r"^\s*(\d+)\s+of\s+(\d+)\s*$"
    return number(c, p, 1), number(c, p, 2)


def clock_seconds(c: Column) -> Column:
    p = r"^\s*(\d+):(\d{1,2})\s*$"
    return number(c, p, 1) * 60 + number(c, p, 2)


def percent(c: Column) -> Column:
    return number(c, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1, "double") / 100


def height_inches(c: Column) -> Column:
    p = r"^\s*(\d+)'\s*(\d+)\"?\s*$"
    return number(c, p, 1) * 12 + number(c, p, 2)


def pounds(c: Column) -> Column:
    return number(c, r"^\s*(\d+)\s*lbs?\.?\s*$")


def reach_inches(c: Column) -> Column:
    return number(c, r"^\s*(\d+(?:\.\d+)?)\"?\s*$", 1, "double")


def date_of(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)).cast("date") for f in formats])


def division(c: Column) -> Column:
    """Standard division named in a weight class, else what is left of the text."""
    s = F.regexp_replace(strip(c), r"\s+", " ")
    left = strip(F.regexp_replace(F.regexp_replace(s, "UFC |Interim | Title Bout", ""), " Bout", ""))
    out = F.when(left != "", left)
    for label in reversed(LIMITS):
        out = F.when(F.lower(left).contains(label.lower()), label).otherwise(out)
    return out


def title_bout(c: Column) -> Column:
    """A divisional title bout, not a tournament's final."""
    s = F.regexp_replace(F.lower(F.regexp_replace(strip(c), r"\s+", " ")), "titlebout", "title bout")
    return F.coalesce(s.contains("title bout") & ~s.rlike("ultimate fighter|road to ufc|tuf nations|tournament") & s.startswith("ufc "), F.lit(False))


def interim_bout(c: Column) -> Column:
    return title_bout(c) & F.lower(c).contains("interim")


#: Patterns of event names and the organisation they name, in order.
ORGANISATIONS = (
    (r"\bufc\b|ultimate fighting", "UFC"), (r"\bpride\b", "PRIDE"), (r"strikeforce", "Strikeforce"), (r"\bwec\b|world extreme cagefighting", "WEC"),
    (r"elitexc|elite xc|\bexc\b", "EliteXC"), (r"affliction", "Affliction"), (r"\bbellator\b", "Bellator"), (r"\bone\b.*championship|one fc|one:", "ONE"),
    (r"\bdream\b", "DREAM"), (r"\bk-1\b", "K-1"), (r"\binvicta\b", "Invicta"), (r"\brizin\b", "RIZIN"),
)


def organisation(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(ORGANISATIONS):
        out = F.when(F.lower(c).rlike(pattern), label).otherwise(out)
    return out


def title_event(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"title|championship|grand prix final|gp final|\bbelt\b|tournament final"), F.lit(False))


def crossing_method(c: Column) -> Column:
    """Method class of another organisation's wording."""
    m = F.lower(c)
    return (
        F.when(c.isNull() | (strip(c) == ""), "Other").when(m.rlike(r"disqualif|\bdq\b"), "DQ").when(m.rlike("could not continue|technical draw"), "Could Not Continue")
        .when(m.rlike(r"overturn|no contest|\bnc\b"), "Overturned").when(m.contains("submission"), "Submission").when(m.contains("ko"), "KO/TKO")
        .when(m.contains("decision"), F.when(m.contains("split"), "Decision - Split").when(m.contains("majority"), "Decision - Majority").otherwise("Decision - Unanimous"))
        .otherwise("Other")
    )


def bout_key(date: Column, a: Column, b: Column) -> Column:
    names = F.array_sort(F.array(F.lower(strip(a)), F.lower(strip(b))))
    return F.concat_ws("::", F.lit("cross"), F.date_format(date, "yyyyMMdd"), F.array_join(names, "|"))


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of two keys."""
    return F.array_join(F.array_distinct(F.array_sort(F.array(a, b))), "|")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "+")


def identifier(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]+", "_")


def name_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z']+)"), F.lit(1)), F.lower), lambda t: F.length(t) > 1)


def flagged_side(details: Column, a: Column, b: Column) -> Column:
    """Which competitor a finding in the details names: more of its name's words, two more for the last; none on a tie."""
    text = F.lower(details)

    def score(name: Column) -> Column:
        tokens = name_tokens(name)
        hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
        return F.when(F.size(tokens) > 0, hits + F.when(F.contains(text, F.element_at(tokens, -1)), 2).otherwise(0)).otherwise(0)

    x, y = score(a), score(b)
    return F.when(details.rlike(r"(?i)failed\s+drug\s+test|illegal\s+inhaler\s+use"), F.when(x > y, a).when(y > x, b))


def names_winner(winner: Column, text: Column) -> Column:
    packed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    parts = F.filter(F.split(F.lower(strip(winner)), r"\s+"), lambda p: F.length(p) >= 3)
    return F.coalesce(F.exists(parts, lambda p: F.contains(packed, F.regexp_replace(p, r"[^\p{L}\p{N}]", ""))), F.lit(False))


def clean_bouts(results: DataFrame, events: DataFrame) -> DataFrame:
    """Raw results (EVENT, BOUT, OUTCOME, WEIGHTCLASS, METHOD, ROUND, TIME, TIME FORMAT, REFEREE, DETAILS, URL) as bouts."""
    c = F.col
    a, b = bout_sides(c("BOUT"))
    x, y = outcomes(c("OUTCOME"))
    method = method_class(c("METHOD"))
    rows = results.join(F.broadcast(events) if events.isLocal() else events, results["EVENT"] == events["event_name"], "left").withColumns({"fighter_a": a, "fighter_b": b, "outcome_a": x, "outcome_b": y, "method_class": method})
    won, lost = (c("outcome_a") == "W") & (c("outcome_b") == "L"), (c("outcome_a") == "L") & (c("outcome_b") == "W")
    nc = F.coalesce((c("outcome_a") == "NC") | (c("outcome_b") == "NC"), F.lit(False))
    reason = F.when(c("method_class") == "Overturned", "method_overturned").when(c("method_class") == "Could Not Continue", "could_not_continue").when(nc, "no_contest")
    return rows.select(
        c("URL").alias("fight_url"), "event_url", c("EVENT").alias("event_name"), "event_date", "event_location", c("BOUT").alias("bout_string"), "fighter_a", "fighter_b", "outcome_a", "outcome_b",
        F.when(won, c("fighter_a")).when(lost, c("fighter_b")).alias("winner"), F.when(won, c("fighter_b")).when(lost, c("fighter_a")).alias("loser"),
        F.coalesce((c("outcome_a") == "D") & (c("outcome_b") == "D"), F.lit(False)).alias("is_draw"), nc.alias("is_nc"), reason.isNotNull().alias("is_excluded"), reason.alias("exclusion_reason"),
        c("WEIGHTCLASS").alias("weight_class"), F.coalesce(F.lower("WEIGHTCLASS").contains("title"), F.lit(False)).alias("is_title_fight"), c("METHOD").alias("method_raw"), "method_class",
        method_score(c("method_class")).alias("method_score_winner"), c("ROUND").try_cast("int").alias("end_round"), clock_seconds(c("TIME")).alias("end_time_seconds"), c("TIME FORMAT").alias("time_format"),
        c("REFEREE").alias("referee"), c("DETAILS").alias("details_text"),
    )


#: Pairs of counts in the round statistics, and the first day of the rules that bouts are rated under.
PAIRS = {"SIG.STR.": "sig_str", "TOTAL STR.": "total_str", "TD": "td", "HEAD": "head", "BODY": "body", "LEG": "leg", "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground"}
ERA_START = "2000-11-17"


def clean_rounds(stats: DataFrame, bouts: DataFrame) -> DataFrame:
    keys = bouts.select("event_name", "bout_string", "fight_url", "event_date")
    rows = stats.join(keys, (stats["EVENT"] == keys["event_name"]) & (stats["BOUT"] == keys["bout_string"]), "left")
    pairs = [x.alias(f"{name}_{what}") for raw, name in PAIRS.items() for x, what in zip(of_pair(F.col(f"`{raw}`")), ("landed", "attempted"), strict=True)]
    return rows.select(
        "fight_url", "event_name", "event_date", "bout_string", number(F.col("ROUND"), r"(\d+)").alias("round_num"), F.col("FIGHTER").alias("fighter"), F.col("KD").try_cast("int").alias("kd"), *pairs,
        percent(F.col("`SIG.STR. %`")).alias("sig_str_pct"), percent(F.col("`TD %`")).alias("td_pct"), F.col("`SUB.ATT`").try_cast("int").alias("sub_att"), F.col("`REV.`").try_cast("int").alias("rev"), clock_seconds(F.col("CTRL")).alias("ctrl_seconds"),
    )


def clean_fighters(tale: DataFrame, details: DataFrame) -> DataFrame:
    names = details.select("URL", F.col("FIRST").alias("first_name"), F.col("LAST").alias("last_name"), F.col("NICKNAME").alias("nickname"))
    return tale.join(names, "URL", "left").select(
        F.col("FIGHTER").alias("fighter"), F.col("URL").alias("fighter_url"), "first_name", "last_name", "nickname", height_inches(F.col("HEIGHT")).alias("height_inches"), pounds(F.col("WEIGHT")).alias("weight_lb"),
        reach_inches(F.col("REACH")).alias("reach_inches"), F.col("STANCE").alias("stance"), date_of(F.col("DOB"), "MMM d, yyyy").alias("dob"),
    )


def integrity_flags(bouts: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Findings, disqualifications and missed weights on bouts; a curated table (event_date, event_name, fighter, substance) overrules."""
    c = F.col
    found = flagged_side(F.coalesce(c("details_text"), F.lit("")), c("fighter_a"), c("fighter_b"))
    text = F.coalesce(c("details_text"), F.lit(""))
    missed = text.rlike(r"(?i)missed\s+weight") & c("winner").isNotNull() & names_winner(c("winner"), text)
    out = bouts.withColumns({
        "ped_confirmed": text.rlike(r"(?i)failed\s+drug\s+test|illegal\s+inhaler\s+use"), "ped_flagged_fighter": found,
        "is_dq": F.coalesce(c("method_class") == "DQ", F.lit(False)), "dq_winner": F.when(c("method_class") == "DQ", c("winner")), "missed_weight": missed, "missed_weight_fighter": F.when(missed, c("winner")),
    })
    if curated is not None:
        key = curated.select("event_date", "event_name", F.col("fighter").alias("_who"), F.col("substance").alias("ped_detail")).dropDuplicates(["event_date", "event_name", "_who"])
        sides = bouts.select("fight_url", "event_date", "event_name", F.explode(F.array("fighter_a", "fighter_b")).alias("_who"))
        hits = sides.join(key, ["event_date", "event_name", "_who"]).groupBy("fight_url").agg(F.min("_who").alias("_who"), F.min("ped_detail").alias("ped_detail"))
        out = out.join(hits, "fight_url", "left").withColumns({"ped_confirmed": c("ped_confirmed") | c("_who").isNotNull(), "ped_flagged_fighter": F.coalesce("_who", "ped_flagged_fighter")}).drop("_who")
    return out

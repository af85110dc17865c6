"""What was known before each event: ranks, titles, streaks, class moves, layoffs. No row sees its own event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, LIMITS, Config
from .spread import released

_BEFORE = (W.unboundedPreceding, -1)


def prefight(history: DataFrame, value: str = "mu", default: float = 1500.0) -> DataFrame:
    """History with the rating before each event and the number of earlier events."""
    w = W.partitionBy("fighter").orderBy("event_seq")
    return history.withColumns({"prefight_mu": F.coalesce(F.lag(value).over(w), F.lit(default)), "prior_events": F.row_number().over(w) - 1})


def deltas(history: DataFrame, value: str = "mu", default: float = 1500.0) -> DataFrame:
    keys = [c for c in ("stream", "fighter") if c in history.columns]
    return history.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(W.partitionBy(*keys).orderBy("event_seq")), F.lit(default)))


def layoffs(appearances: DataFrame) -> DataFrame:
    w = W.partitionBy("fighter").orderBy("event_date", "event_name", "bout_id")
    return appearances.withColumn("activity_gap_days", F.datediff("event_date", F.lag("event_date").over(w)))


def win_streaks(appearances: DataFrame) -> DataFrame:
    """Consecutive wins before the event; anything else, a missing winner too, sets them to nothing.

    A competitor's results of one event count together after it: wins after the event's last break.
    """
    order = W.partitionBy("fighter").orderBy("event_seq", "bout_id")
    marked = appearances.select("fighter", "event_seq", "bout_id", "is_winner", F.sum(F.when(F.col("is_winner"), 0).otherwise(1)).over(order).alias("island"))
    run = marked.withColumn("run", F.sum(F.when(F.col("is_winner"), 1).otherwise(0)).over(W.partitionBy("fighter", "island").orderBy("event_seq", "bout_id")))
    after = run.groupBy("fighter", "event_seq").agg(F.max_by("run", "bout_id").alias("after"))
    entering = after.withColumn("streak", F.coalesce(F.lag("after").over(W.partitionBy("fighter").orderBy("event_seq")), F.lit(0)))
    return appearances.join(entering.select("fighter", "event_seq", "streak"), ["fighter", "event_seq"])


def class_moves(appearances: DataFrame) -> DataFrame:
    """The last standard division before the event, and the move from there."""
    limits = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    here = limits[F.col("division")]
    w = W.partitionBy("fighter").orderBy("event_seq").rangeBetween(*_BEFORE)
    # within an event the later bout's division is the one that stays
    stay = F.max_by("division", F.struct("event_seq", "bout_id"))
    per_event = appearances.where(here.isNotNull()).groupBy("fighter", "event_seq").agg(stay.alias("_division"))
    every = appearances.select("fighter", "event_seq").distinct().join(per_event, ["fighter", "event_seq"], "left")
    previous = every.withColumn("previous_division", F.last("_division", ignorenulls=True).over(w)).drop("_division")
    return moved(appearances.join(previous, ["fighter", "event_seq"]))


def moved(rows: DataFrame) -> DataFrame:
    """The move from previous_division to division."""
    limits = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    here, before = limits[F.col("division")], limits[F.col("previous_division")]
    move = F.when(before.isNull() | here.isNull(), "unknown").when(here > before, "up").when(here < before, "down").otherwise("same")
    return rows.withColumns({"weight_limit": here, "previous_limit": before, "move": move, "change_fight": move.isin("up", "down")})


def title_lineage(bouts: DataFrame) -> DataFrame:
    """Champion and interim champion of the bout's division when its event begins.

    An undisputed title result also clears the interim holder; draws change nothing.
    """
    here = (F.col("winner").isNotNull()) & F.col("is_title") & F.col("division").isNotNull()
    place = F.struct("event_seq", "bout_id")
    results = bouts.where(here).groupBy("division", "event_seq").agg(
        F.max(F.when(~F.col("is_interim"), F.struct(place.alias("at"), F.col("winner").alias("who")))).alias("full"),
        F.max(F.when(F.col("is_interim"), F.struct(place.alias("at"), F.col("winner").alias("who")))).alias("interim"),
    )
    days = bouts.select("division", "event_seq").distinct().join(results, ["division", "event_seq"], "left")
    w = W.partitionBy("division").orderBy("event_seq").rangeBetween(*_BEFORE)
    held = days.withColumns({"full": F.max("full").over(w), "interim": F.max("interim").over(w)})
    held = held.select(
        "division", "event_seq", F.col("full.who").alias("champion"), F.when(F.col("full").isNull() | (F.col("interim.at") > F.col("full.at")), F.col("interim.who")).alias("interim_champion")
    )
    out = bouts.join(F.broadcast(held), ["division", "event_seq"], "left")  # a row for each event and division
    for s in "ab":
        out = out.withColumns({
            f"entered_champion_{s}": F.coalesce(F.col(f"fighter_{s}") == F.col("champion"), F.lit(False)),
            f"entered_interim_{s}": F.coalesce(F.col(f"fighter_{s}") == F.col("interim_champion"), F.lit(False)),
        })
    return out


#: Days of events that one task ranks at a time.
BLOCK = 30


def _ranked(days: int):
    """One block's events (rows without a competitor) and the states that reach into it, to the ranks of the bouts that the states end with."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        event = pa.compute.is_null(table["fighter"])
        events, rows = table.filter(event).sort_by("from_seq"), table.filter(pa.compute.invert(event))
        del table, event
        seq, date = events["from_seq"].to_numpy(), events["from_date"].cast(pa.int32()).to_numpy()
        last = rows["to_seq"].fill_null(np.iinfo(np.int64).max).to_numpy()
        lo, hi = np.searchsorted(seq, rows["from_seq"].to_numpy(), "right"), np.searchsorted(seq, last, "right")
        hi = np.minimum(hi, np.searchsorted(date, rows["from_date"].cast(pa.int32()).to_numpy() + days, "right"))
        rows, lo, hi, last = rows.filter(pa.array(lo < hi)), lo[lo < hi], hi[lo < hi], last[lo < hi]
        n, mu = len(rows), rows["mu"].combine_chunks()
        by = pa.table({"mu": pa.compute.if_else(pa.compute.is_nan(mu), np.inf, mu), "fighter": rows["fighter"]})  # Spark sorts NaN as the largest
        order = pa.compute.sort_indices(by, [("mu", "descending"), ("fighter", "ascending")]).to_numpy()
        division = pa.compute.dictionary_encode(rows["division"].combine_chunks()).indices.fill_null(-1).to_numpy()
        apart = order[np.argsort(division[order], kind="stable")]
        place, inside = np.empty(n, np.int64), np.empty(n, np.int64)
        place[order] = inside[apart] = np.arange(n)
        head = np.searchsorted(division[apart], division, "left")  # where the own division begins
        at = np.searchsorted(seq, last, "left")
        asks = np.flatnonzero(rows["asks"].is_valid().to_numpy(zero_copy_only=False) & (at < hi))
        p4p, ranks, cuts = np.zeros(n, np.int32), np.zeros(n, np.int32), np.arange(len(seq) + 2)
        begin, end, asked = np.argsort(lo, kind="stable"), np.argsort(hi, kind="stable"), asks[np.argsort(at[asks], kind="stable")]
        b, e, k = np.searchsorted(lo[begin], cuts), np.searchsorted(hi[end], cuts), np.searchsorted(at[asked], cuts)
        live, each = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for i in range(len(seq)):
            for who, value in ((begin[b[i] : b[i + 1]], 1), (end[e[i] : e[i + 1]], 0)):
                live[place[who]] = each[inside[who]] = value
            if len(who := asked[k[i] : k[i + 1]]):
                p4p[who] = np.cumsum(live)[place[who]]
                run = np.concatenate(([0], np.cumsum(each)))
                ranks[who] = run[inside[who] + 1] - run[head[who]]
        lists = rows["asks"].combine_chunks().take(pa.array(asks))
        each_one = asks[pa.compute.list_parent_indices(lists).to_numpy()]
        bout = pa.compute.list_flatten(lists)
        yield from pa.table({
            "bout_id": bout.field("bout_id"), "side": bout.field("side"), "ranked_division": rows["division"].take(pa.array(each_one)),
            "p4p_rank": pa.array(p4p[each_one]), "division_rank": pa.array(ranks[each_one], mask=division[each_one] < 0),
        }).to_batches(10_000)

    return run


def ranks(bouts: DataFrame, appearances: DataFrame, history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per appearance: rank before the event, in the division of the competitor's last bout and over all, among those active within three years.

    Each history row is valid from the next event until the competitor's next one, and then answers for the bouts there.
    States go to the blocks of days that they reach into, and a block counts, event by event, who stands before those
    who appear: no table of events times active competitors is made or sorted.
    """
    rows = appearances.where("fighter is not null").groupBy("fighter", "event_seq").agg(F.max_by("division", "bout_id").alias("division"), F.collect_list(F.struct("bout_id", "side")).alias("here"))  # a competitor's bouts of one event
    w = W.partitionBy("fighter").orderBy("event_seq")
    state = rows.join(history.select("fighter", "event_seq", F.struct("mu", F.col("event_date").alias("from_date")).alias("_state")), ["fighter", "event_seq"], "left")
    state = state.withColumn("_state", F.when(F.col("_state").isNotNull(), F.struct("division", "_state.mu", "_state.from_date")))
    # an appearance that history lacks is answered by the state before it, which then goes on
    state = state.select("fighter", F.last("_state", ignorenulls=True).over(w).alias("_state"), F.col("event_seq").cast("long").alias("from_seq"), F.lead("event_seq").over(w).cast("long").alias("to_seq"), F.lead("here").over(w).alias("asks"))
    state = state.where("_state is not null").select("fighter", "_state.*", "from_seq", "to_seq", "asks")
    dates = bouts.select(F.col("event_seq").cast("long").alias("from_seq"), F.col("event_date").alias("from_date")).where("from_date is not null").distinct()

    def block(c):
        return F.floor(F.datediff(c, F.lit("1970-01-01")) / BLOCK)

    ends = F.broadcast(dates.select(F.col("from_seq").alias("to_seq"), F.col("from_date").alias("to_date")))  # a row for each event
    state = state.join(ends, "to_seq", "left")
    until = F.date_add("from_date", cfg.active_days)
    state = state.withColumn("block", F.explode(F.sequence(block("from_date"), block(F.least(F.coalesce("to_date", until), until)))))
    state = state.withColumn("asks", F.when(F.col("block") == block("to_date"), F.col("asks"))).drop("to_date")
    both = state.unionByName(dates.withColumn("block", block("from_date")), allowMissingColumns=True)
    kinds = dict(appearances.select("bout_id", "side", "division").dtypes)
    schema = f"bout_id {kinds['bout_id']}, side string, ranked_division string, p4p_rank int, division_rank int"
    return both.groupBy("block").applyInArrow(released(_ranked(cfg.active_days)), schema)


def by_bout(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Rows by bout_id and side as one row a bout, with x_a and x_b for each x of `values`."""
    out = rows.repartition("bout_id").groupBy("bout_id").agg(*[F.max(F.when(F.col("side") == s, F.struct(*values))).alias(f"_{s}") for s in "ab"])
    return out.select("bout_id", *[F.col(f"_{s}.{x}").alias(f"{x}_{s}") for s in "ab" for x in values])


def with_ranks(bouts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Both sides' ranks on each bout; a division rank counts only in that division."""
    out = bouts.join(by_bout(ranked, ("ranked_division", "p4p_rank", "division_rank")), "bout_id", "left")
    return out.withColumns({f"division_rank_{s}": F.when(F.col(f"ranked_division_{s}") == F.col("division"), F.col(f"division_rank_{s}")) for s in "ab"}).drop("ranked_division_a", "ranked_division_b")


def entering(appearances: DataFrame, prior: DataFrame) -> DataFrame:
    """What a competitor brings to each bout, by bout_id and side: streak, previous_division, activity_gap_days and prefight_mu.

    The same as win_streaks, class_moves, layoffs and `prior`, but in one exchange by competitor: ratings pass as rows of their own.
    """
    standard = F.when(F.col("division").isin(*LIMITS), F.col("division"))
    mine = appearances.select("fighter", "event_seq", "bout_id", "side", "event_date", F.col("is_winner").alias("won"), standard.alias("division"))
    rows = mine.unionByName(prior.select("fighter", "event_seq", "prefight_mu"), allowMissingColumns=True).where("fighter is not null").repartition("fighter")
    order = W.partitionBy("fighter").orderBy("event_seq", "bout_id")
    earlier = W.partitionBy("fighter").orderBy("event_seq").rangeBetween(*_BEFORE)
    c, zero = F.col, F.lit(0).cast("long")
    rows = rows.withColumns({"_wins": F.sum(F.when(c("won"), 1).otherwise(0)).over(order), "activity_gap_days": F.datediff("event_date", F.last("event_date", ignorenulls=True).over(order.rowsBetween(*_BEFORE)))})
    rows = rows.withColumns({
        "streak": F.coalesce(F.max("_wins").over(earlier), zero) - F.coalesce(F.max(F.when(~c("won"), c("_wins"))).over(earlier), zero),  # wins till then, less those till the last break
        "_last": F.max(F.when(c("division").isNotNull(), F.struct("event_seq", "bout_id", "division"))).over(earlier),
        "prefight_mu": F.max("prefight_mu").over(W.partitionBy("fighter", "event_seq")),
    })
    return rows.where("side is not null").select("bout_id", "side", "streak", c("_last.division").alias("previous_division"), "activity_gap_days", "prefight_mu")


def all_streaks(appearances: DataFrame, least: int = 2) -> DataFrame:
    """Every maximal run of wins of at least `least`: its length, ends, opponents, most frequent division, and what ended it."""
    order = W.partitionBy("fighter").orderBy("event_date", "event_name", "bout_id")
    outcome = F.when(F.col("is_draw"), "draw").when(F.col("is_winner"), "win").otherwise("loss")
    rows = appearances.where("not coalesce(is_nc, false)") if "is_nc" in appearances.columns else appearances
    rows = rows.withColumn("outcome", outcome).withColumn("island", F.sum(F.when(F.col("outcome") == "win", 0).otherwise(1)).over(order))
    # a break carries the number of the island that it opens, and closes the one before
    breaks = rows.where("outcome <> 'win'").select("fighter", (F.col("island") - 1).alias("island"), F.col("outcome").alias("ended_by"))
    won = rows.where("outcome = 'win'").groupBy("fighter", "island").agg(
        F.count(F.lit(1)).alias("length"), F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_date", "event_name", "bout_id", "opponent"))), lambda x: x["opponent"]), ", ").alias("opponents"),
        F.mode("division", deterministic=True).alias("division"), F.count_if(F.col("is_title")).alias("title_wins"), F.count_if(F.col("method_class").isin("KO/TKO", "Submission")).alias("finishes"),
    ).where(F.col("length") >= least)
    return won.join(breaks, ["fighter", "island"], "left").withColumn("ongoing", F.col("ended_by").isNull()).drop("island")

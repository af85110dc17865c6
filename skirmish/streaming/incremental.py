"""Ratings kept up to date by a stream of bouts.

State is held by pool: each competitor's rating, deviation, volatility and last day. A micro-batch's events are rated
in order, each once and as a whole. Events that end up older than the pool's newest rated one are not rated: they come
out marked late, for a batch replay from their day on.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config
from ..operators.kernels import rate

SCHEMA = "pool string, fighter string, event_date date, event_name string, mu double, phi double, sigma double, late boolean"
STATE = "newest string, ratings string"


def apply_event(state: dict, rows: pd.DataFrame, day: int, cfg: Config = DEFAULT) -> list[tuple]:
    """Rate one event's bouts on a pool's state: fighter to [mu, phi, sigma, day], scaled."""
    names = list(dict.fromkeys([*rows["fighter_a"], *rows["fighter_b"]]))
    at = {n: i for i, n in enumerate(names)}
    old = np.array([state.get(n, [0.0, cfg.phi0 / cfg.ratio, cfg.sigma0, day]) for n in names])
    mu, sigma = old[:, 0], old[:, 2]
    phi = np.sqrt(old[:, 1] ** 2 + ((day - old[:, 3]) / cfg.days_per_month).astype(np.int64) * sigma**2)
    rated = rows[rows["s_a"].notna()]
    a, b, s = rated["fighter_a"].map(at).to_numpy(int), rated["fighter_b"].map(at).to_numpy(int), rated["s_a"].to_numpy(float)
    me, other, score = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, 1 - s))
    g = 1 / np.sqrt(1 + 3 * phi[other] ** 2 / np.pi**2)
    e = 1 / (1 + np.exp(-g * (mu[me] - mu[other])))
    k = len(names)
    new = rate(mu, phi, sigma, np.bincount(me, g**2 * e * (1 - e), k), np.bincount(me, g * (score - e), k), cfg.tau)
    played = np.bincount(me, minlength=k) > 0
    out = []
    for i, n in enumerate(names):
        m, p, v = (x[i] for x in new) if played[i] else (mu[i], phi[i], sigma[i])
        state[n] = [float(m), float(p), float(v), day]
        out.append((n, m * cfg.ratio + cfg.mu0, p * cfg.ratio, v))
    return out


def rated_stream(bouts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A stream of bouts (pool, bout_id, event_date, event_name, fighter_a, fighter_b, s_a) to history rows."""

    def run(key, batches, held: GroupState):
        newest, state = (held.get[0], json.loads(held.get[1])) if held.exists else ("", {})
        rows = pd.concat(list(batches), ignore_index=True)
        rows["event_date"] = pd.to_datetime(rows["event_date"]).dt.date
        out = []
        for (date, name), event in rows.sort_values(["event_date", "event_name", "bout_id"]).groupby(["event_date", "event_name"], sort=True):
            mark = f"{date}|{name}"
            if mark <= newest:
                out += [(key[0], n, date, name, None, None, None, True) for n in dict.fromkeys([*event["fighter_a"], *event["fighter_b"]])]
                continue
            newest = mark
            day = (pd.Timestamp(date) - pd.Timestamp(0)).days
            out += [(key[0], n, date, name, m, p, v, False) for n, m, p, v in apply_event(state, event, day, cfg)]
        held.update((newest, json.dumps(state)))
        yield pd.DataFrame(out, columns=["pool", "fighter", "event_date", "event_name", "mu", "phi", "sigma", "late"])

    rows = bouts.select("pool", "bout_id", F.col("event_date").cast("date").alias("event_date"), "event_name", "fighter_a", "fighter_b", "s_a")
    return rows.groupBy("pool").applyInPandasWithState(run, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)

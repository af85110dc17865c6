"""Names of rating columns: public labels, streams, and which column backs a choice of lens and time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.periods import prime_minimum
from .library import stream_of

#: Columns with a short name of their own.
COLUMN_LABELS = {
    "sustained_peak_headline_mu_canonical": "Prime Wins", "sustained_peak_headline_mu_method": "Prime Finishes", "sustained_peak_headline_mu_method_integrity": "Prime Clean",
    "sustained_peak_headline_mu_method_performance": "Prime Strength", "sustained_peak_headline_mu_method_integrity_performance": "Prime Complete", "sustained_peak_headline_mu_whr": "Legacy",
    "sustained_peak_headline_mu_whr_integrity": "Legacy Clean", "sustained_peak_headline_mu_whr_performance": "Legacy Strength", "sustained_peak_headline_mu_whr_integrity_performance": "Legacy Complete",
}
#: What charts call the current columns.
METRIC_LABELS = {
    "mu_canonical": "Wins rating", "phi_canonical": "Rating uncertainty", "mu_method": "Finishes rating", "mu_method_integrity": "Clean rating",
    "mu_method_performance": "Strength rating", "mu_method_integrity_performance": "Complete rating", "mu_whr": "Legacy rating",
}
#: Lenses with their label, stream and table of history; views of time with their label.
LENSES = {
    "wins": ("Wins", "canonical", "ratings_history"), "finishes": ("Finishes", "method", "ratings_history"), "clean": ("Clean", "method_integrity", "ratings_history_method_integrity"),
    "strength": ("Strength", "method_performance", "ratings_history_method_performance"), "complete": ("Complete", "method_integrity_performance", "ratings_history_method_integrity_performance"),
    "legacy": ("Legacy", "whr", "ratings_history_whr"),
}
VIEWS = {"current": "Now", "five_year_peak": "Peak", "sustained_peak": "Prime"}


def column_label(column: str) -> str:
    return COLUMN_LABELS.get(column, column)


def metric_label(column: str) -> str:
    return METRIC_LABELS.get(column) or column_label(column).replace("_", " ")


def labelled(df: DataFrame) -> DataFrame:
    """`df` with its rating columns under their short names."""
    return df.withColumnsRenamed({c: label for c, label in COLUMN_LABELS.items() if c in df.columns})


def view_label(lens: str, view: str) -> str:
    return f"{VIEWS.get(view, view)} {LENSES[lens][0] if lens in LENSES else lens}"


def lens_stream(lens: str) -> str:
    if lens not in LENSES:
        raise ValueError(f"unknown lens: {lens!r}")
    return LENSES[lens][1]


def history_table(lens: str) -> str:
    return LENSES[lens][2] if lens in LENSES else "ratings_history"


def backing_column(columns: list[str], stream: str, view: str = "current") -> str | None:
    """The first column there is for a stream and a view: its own headline, its own plain score, those of its base stream, then the next shorter view."""
    if view not in VIEWS:
        raise ValueError(f"unknown view: {view!r}")
    if view == "current":
        wanted = [f"mu_{stream}"]
    else:
        base = "method" if stream.startswith("method") else "canonical"
        wanted = [f"{view}_{kind}mu_{s}" for s in (stream, base) for kind in ("headline_", "")]
        if view == "sustained_peak":
            wanted += [f"five_year_peak_{kind}mu_{stream}" for kind in ("headline_", "")]
    return next((c for c in wanted if c in columns), None)


def composed_column(columns: list[str], method: str, integrity: bool = False, performance: bool = False, view: str = "current") -> str | None:
    return backing_column(columns, stream_of(method, integrity, performance), view)


def composition(method: str, integrity: bool = False, performance: bool = False) -> dict[str, str]:
    """Labels of a method with its sleeves, and the column that it is compared with."""
    stream = stream_of(method, integrity, performance)
    plain, column = ("Wins", "mu_canonical") if method == "canonical" else ("Finishes", "mu_method")
    sleeves = " + ".join(["Clean"] * integrity + ["Strength"] * performance)
    label = "Complete" if integrity and performance else sleeves or plain
    return {"stream": stream, "label": label, "detail": f"{plain} with {(sleeves or 'No context').lower()}", "baseline_col": column, "baseline_label": plain}


def stream_of_column(column: str) -> str:
    """The stream whose rating a column holds."""
    return column.rsplit("mu_", 1)[-1]


def prime_columns(stream: str, years: int, least: int | None = None) -> tuple[str, str]:
    """Names of an N-year period's plain and headline column."""
    stem = f"prime_{int(years)}yr" + ("" if least is None else f"_{int(least)}f")
    return f"{stem}_mu_{stream}", f"{stem}_headline_mu_{stream}"


def prime_spec(years: int, least: int | None = None) -> tuple[int, int, int]:
    """Days, least bouts and least raw bouts of an N-year period, of a given least where there is one."""
    days, usual, raw = prime_minimum(years)
    return (days, usual, raw) if least is None else (days, int(least), max(6, -(-3 * int(least) // 4)))

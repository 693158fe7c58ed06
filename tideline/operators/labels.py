"""Walk-forward labels, and reports on labels (method, date, regime)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..models.states import ChangePoints, Detector, make_detector


def walk_forward(z: DataFrame, method: str | Callable[[], Detector], min_train: int = 252, refit_every: int = 63, by: tuple[str, ...] = (), name: str | None = None, **settings) -> DataFrame:
    """by, method, date, regime: states of each day, as a model fitted on days before it sees them.

    z: by, date, z (array of doubles). method: a known model's name with its settings, or a function without arguments that makes
    a Detector (name: what the column method says then). Each refit of each panel is a row of its own with the days it may see, so all
    are parallel; a panel's days meet in one row. ValueError for nulls or a panel that is too short.
    """
    known = isinstance(method, str)
    title, make = (method, lambda: make_detector(method, **settings)) if known else (name or getattr(method, "__name__", type(method).__name__), method)
    if known:
        make()
    null = F.col("z").isNull() | F.exists("z", lambda x: x.isNull() | F.isnan(x))
    shape = z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls")).agg(F.sum("nulls").alias("nulls"), F.min("n").alias("least"), F.sum(F.ceil((F.col("n") - min_train) / refit_every)).alias("refits")).first()
    if shape["nulls"]:
        raise ValueError("the matrix has nulls")
    if min_train >= (shape["least"] or 0):
        raise ValueError("not more rows than min_train")
    packed = z.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", "z"))).alias("_s"))
    packed = packed.select(*by, F.transform("_s", lambda r: r["date"]).alias("_days"), F.flatten(F.transform("_s", lambda r: r["z"])).alias("_x"))
    n = F.size("_days")
    refits = packed.withColumn("_start", F.explode(F.sequence(F.lit(min_train), n - 1, F.lit(refit_every)))).withColumn("_end", F.least(F.col("_start") + refit_every, n))
    seen = F.slice("_x", F.lit(1), F.col("_end") * (F.size("_x") / n).cast("int"))
    refits = refits.select(*by, "_start", "_end", F.slice("_days", F.col("_start") + 1, F.col("_end") - F.col("_start")).alias("_days"), seen.alias("_x"))
    refits = refits.repartition(max(1, min(int(shape["refits"]), 2048), int(shape["refits"]) // 64))

    def label(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                start, end = row["_start"], row["_end"]
                x = np.asarray(row["_x"], dtype=float).reshape(end, -1)
                model = make().fit(x[:start])
                states = model.filtered_states(x, start) if isinstance(model, ChangePoints) else model.filtered_states(x)[start:]
                yield pd.DataFrame({**{c: [row[c]] * (end - start) for c in by}, "method": title, "date": row["_days"], "regime": np.asarray(states).astype("int32")})

    keys = "".join(f"`{c}` {t}, " for c, t in z.select(*by).dtypes) if by else ""
    return refits.mapInPandas(label, keys + "method string, date date, regime int")


def states(z: DataFrame, model: Detector, by: tuple[str, ...] = (), smoothed: bool = False) -> DataFrame:
    """by, date, regime, proba of each day under a fitted model: as known by that day, or (smoothed) on the best path through all days, without proba. z: by, date, z; a panel is one task."""

    def label(pdf):
        import pandas as pd

        pdf = pdf.sort_values("date", ignore_index=True)
        x = np.array(pdf["z"].tolist(), dtype=float)
        proba = None if smoothed else model.filtered_proba(x)
        regime = model.smoothed_states(x) if smoothed else proba.argmax(1)
        return pd.DataFrame({**{c: pdf[c] for c in by}, "date": pdf["date"], "regime": regime.astype("int32"), "proba": [None] * len(x) if smoothed else proba.tolist()})

    keys = "".join(f"`{c}` {t}, " for c, t in z.select(*by).dtypes) if by else ""
    return z.groupBy(*by).applyInPandas(label, keys + "date date, regime int, proba array<double>")


def runs(labels: DataFrame) -> DataFrame:
    """Contiguous runs of a label: method, run, regime, start, end, days."""
    w = Window.partitionBy("method").orderBy("date")
    changed = F.when(F.col("regime").eqNullSafe(F.lag("regime").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = labels.withColumn("change", changed).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("method", "run", "regime").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"))


def distribution(labels: DataFrame, n_states: int = 3) -> DataFrame:
    """Days and share of every state of every method, states without days included."""
    states = labels.select("method").distinct().withColumn("regime", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    counted = labels.groupBy("method", "regime").agg(F.count(F.lit(1)).alias("n"))
    days = F.coalesce("n", F.lit(0))
    return states.join(counted, ["method", "regime"], "left").select("method", "regime", days.alias("days"), F.try_divide(days.cast("double"), F.sum(days).over(Window.partitionBy("method"))).alias("share"))


def persistence(labels: DataFrame) -> DataFrame:
    """Mean run, switches and switches a year (of calendar days)."""
    return runs(labels).groupBy("method").agg(F.avg("days").alias("mean_run"), (F.count(F.lit(1)) - 1).alias("switches"), (F.datediff(F.max("end"), F.min("start")) / 365.25).alias("years")).select(
        "method", "mean_run", "switches", F.try_divide(F.col("switches").cast("double"), F.col("years")).alias("switches_per_year")
    )


def crisis_share(labels: DataFrame, windows: DataFrame, n_states: int = 3, every: bool = False) -> DataFrame:
    """Share of days in the worst state in each window (both ends inside) and outside all ('outside'); every: windows without days too, with a null share."""
    in_window = labels.join(F.broadcast(windows), F.col("date").between(F.col("start"), F.col("end")), "left")
    out = in_window.groupBy("method", F.coalesce("name", F.lit("outside")).alias("window")).agg(F.count(F.lit(1)).alias("days"), F.avg((F.col("regime") == n_states - 1).cast("double")).alias("crisis_share"))
    if not every:
        return out
    names = windows.agg(F.array_append(F.sort_array(F.collect_set("name")), F.lit("outside")).alias("names"))
    grid = labels.select("method").distinct().join(F.broadcast(names)).select("method", F.explode("names").alias("window"))
    return grid.join(out, ["method", "window"], "left").na.fill(0, ["days"])


def agreement(labels: DataFrame) -> DataFrame:
    """Percent of common days on which two methods agree."""
    b = labels.select("date", F.col("method").alias("b"), F.col("regime").alias("rb"))
    return labels.select("date", F.col("method").alias("a"), F.col("regime").alias("ra")).join(b, "date").where("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("days"), (F.avg((F.col("ra") == F.col("rb")).cast("double")) * 100).alias("agreement")
    )

"""Streaming forms: windowed aggregates that equal the batch result, and the online state filter."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n and mean_value in one-hour windows; late: a watermark, for streams."""
    source = events.withWatermark("ts", late) if late else events
    out = source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "mean_value")


def online_states(rows: DataFrame, model, key: str = "panel_id") -> DataFrame:
    """key, date, regime of a stream of (key, date, z) that comes in order of date, by a fitted hidden Markov model: what is known is the state's log probabilities."""
    start, move = np.log(model.start + 1e-300), np.log(model.move + 1e-300)

    def step(k, batches, state):
        import pandas as pd

        now = np.array(state.get[0]) if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("date")
            logb, out = model.density(np.array(pdf["z"].tolist(), dtype=float), model.means, model.var), []
            for b in logb:
                prior = start if now is None else np.logaddexp.reduce(now[:, None] + move, 0)
                now = prior + b
                now = now - np.logaddexp.reduce(now)
                out.append(int(now.argmax()))
            yield pd.DataFrame({key: k[0], "date": pdf["date"], "regime": np.array(out, dtype="int32")})
        if now is not None:
            state.update((now.tolist(),))

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, date date, regime int", "alpha array<double>", "append", "NoTimeout")

"""Reports: small tables, computed as DataFrames, written as Markdown; and logging of runs."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame

from .operators.features import metadata


def logger(name: str = "tideline", level: str = "INFO", file: str | None = None) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        for handler in (logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])):
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(handler)
    return log


@contextmanager
def step(log: logging.Logger, what: str, spark=None):
    """Logs begin, end and seconds of a step, and names its Spark jobs after it."""
    began = time.perf_counter()
    log.info("%s: begins", what)
    if spark is not None:
        spark.sparkContext.setJobDescription(what)
    try:
        yield
    except Exception:
        log.error("%s: failed after %.1f s", what, time.perf_counter() - began)
        raise
    log.info("%s: %.1f s", what, time.perf_counter() - began)


def markdown_table(df: DataFrame, order: list[str] | None = None, most: int = 500) -> str:
    """df as a Markdown table; reports hold at most a few rows for each asset, method or strategy, and more than most is an error."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_report(path: str, title: str, parts: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> str:
    """A Markdown file with one section for each table."""
    text = f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown_table(df, (order or {}).get(name))}\n" for name, df in parts.items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return text


def data_dictionary(columns: list[str]) -> str:
    lines = ["# Data dictionary", "", "| name | kind | description |", "|---|---|---|"]
    return "\n".join(lines + [f"| {m['name']} | {m['kind']} | {m['description']} |" for m in metadata(columns)]) + "\n"

"""Quality rules on documents, and verdicts on their hosts."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of width words which the text holds twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    code = ids[:n]
    for k in range(1, width):
        # Numbered anew after each word, so codes stay under the square of the text's length.
        code = np.unique(code, return_inverse=True)[1] * len(number) + ids[k : k + n] if k > 1 else code * len(number) + ids[k : k + n]
    _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    hit = np.flatnonzero(counts[at] > 1)
    np.add.at(inside, hit, 1)
    np.add.at(inside, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(inside)[:-1]))


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(joined) - chars, len(text) - len(text.translate(None, SYMBOLS)), repeats, repeated_words(words)


def with_stats(docs: DataFrame, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """row (a struct of the columns keep of docs, all by default) and stats (a struct) of each whole text; null counts as empty."""
    keep = docs.columns if keep is None else keep
    inside = text_column in keep

    def run(batches):
        import pyarrow as pa

        common.forget()
        for batch in common.slices(batches):
            row = batch.column(0)
            stats = [text_stats(t or b"") for t in common.text_bytes(row.field(text_column) if inside else batch.column(1))]
            columns = [pa.array([s[k] for s in stats], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays(columns, [f.split()[0] for f in STATS.split(", ")])], names=["row", "stats"])

    rows = common.as_row(docs.select(*[F.col(f"`{c}`") for c in keep])) if inside else docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_column).alias("text"))
    inner = T.StructType([T.StructField(f.split()[0], T.LongType()) for f in STATS.split(", ")])
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("stats", inner)]))


def document_rules(least_words: int = 50, most_repeated: int = 50) -> dict[str, F.Column]:
    """Rules on stats; true where a document fails. The first two are the base: a document that fails one goes."""
    s = {name: F.col(f"stats.{name}") for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return {
        "few_words": s["n_words"] < least_words,
        "repeats": 100 * s["n_repeat_words"] > most_repeated * s["n_words"],
        "symbols": 10 * s["n_symbols"] > s["n_words"],
        "word_length": (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"]),
    }


def host_verdicts(judged: DataFrame, host: str, rules: list[str], max_rate: float, max_strength: float = 1000.0) -> DataFrame:
    """host, its documents n, and bad: true if the shrunken failure rate of any rule is over max_rate.

    A rule's failures on a host are binomial, their rate drawn from a beta prior that is fitted to all hosts by
    moments: mean m over all documents, and the variance between hosts beyond that of counting. The shrunken
    rate is the posterior mean (failures + m k) / (n + k), k = m (1 - m) / variance - 1, between 1 and
    max_strength; with no variance beyond counting k is max_strength. Counts are combined before the shuffle, so a host with a third of all rows is one row
    for each task; judged has the rules as boolean columns.
    """
    fails = [F.sum(F.col(r).cast("long")).alias(r) for r in rules]
    hosts = common.written(judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *fails), "host-failures")
    moments = hosts.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"), F.count(F.lit(1)).alias("hosts"),
        *(x for r in rules for x in (F.sum(r).alias(f"{r}_f"), F.sum(F.col(r) * F.col(r).cast("double") / F.col("n")).alias(f"{r}_q"))),
    ).first()
    bad = F.lit(False)
    for r in rules:
        total = float(moments["n"] or 0)
        m = (moments[f"{r}_f"] or 0) / total if total else 0.0
        # Between-host variance: weighted squares about m, less what counting alone gives (the usual moment estimate).
        squares = (moments[f"{r}_q"] or 0.0) - total * m * m
        free = moments["hosts"] - 1
        spread = total - (moments["n2"] or 0.0) / total if total else 0.0
        between = (squares - free * m * (1 - m)) / (spread - free) if spread - free > 0 else 0.0
        k = max_strength if between <= 0 else min(max_strength, max(1.0, m * (1 - m) / between - 1))
        bad = bad | ((F.col(r) + m * k) / (F.col("n") + k) > max_rate)
    return hosts.select(F.col(host).alias("host"), F.col("n").alias("host_docs"), bad.alias("host_bad"))


def judge(docs: DataFrame, host_column: str = "source", text_column: str = "text", max_rate: float = 0.6) -> DataFrame:
    """docs with _stats, base_failed and kept.

    kept is false if a base rule fails, else the verdict on the host: false if the shrunken failure rate of any
    rule there is over max_rate. Null hosts count as one host. Null or empty texts have no words and fail.
    Repeated rows count as often as they occur. Empty tables stay empty. Columns of docs named _stats,
    base_failed or kept (in any case) are replaced; others pass through, whatever they are called. Texts are read
    once: rows and their counts are written, hosts are judged from the counts.
    """
    columns = common.without(docs.columns, "_stats", "base_failed", "kept")
    stats = common.written(with_stats(docs, columns, text_column), "quality-stats")
    judged = judged_rows(stats, host_column, max_rate)
    return judged.select(*common.row_columns(columns), F.col("stats").alias("_stats"), "base_failed", "kept")


def kept_documents(docs: DataFrame, host_column: str = "source", text_column: str = "text", max_rate: float = 0.6) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs as they were. Nulls, ties, repeats and empty tables as there. Rows that fail a base rule leave their counts behind only."""
    rules, host = document_rules(), F.col("row").getField(host_column)
    base = rules["few_words"] | rules["repeats"]
    counted = with_stats(docs, None, text_column).select(F.when(~base, F.col("row")).alias("row"), host.alias("host"), "stats")
    counted = common.written(counted, "quality-stats")
    hosts = host_verdicts(counted.select("host", *(c.alias(r) for r, c in rules.items())), "host", list(rules), max_rate)
    bad = hosts.where("host_bad").select(F.col("host").alias("bad_host"))
    won = counted.where("row IS NOT NULL").join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return won.select(*common.row_columns(docs.columns))


def judged_rows(stats: DataFrame, host_column: str, max_rate: float) -> DataFrame:
    """with_stats()'s rows (written) with base_failed and kept.

    Only hosts with a bad verdict are joined: they are few next to all hosts, and no document of another host moves far.
    """
    rules, host = document_rules(), F.col("row").getField(host_column)
    hosts = host_verdicts(stats.select(host.alias("host"), *(c.alias(r) for r, c in rules.items())), "host", list(rules), max_rate)
    bad = hosts.where("host_bad").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    base = rules["few_words"] | rules["repeats"]
    joined = stats.join(bad, host.eqNullSafe(F.col("bad_host")), "left")
    return joined.select("row", "stats", base.alias("base_failed"), (~base & F.col("bad").isNull()).alias("kept"))

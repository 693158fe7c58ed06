"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = 3.0) -> list[float]:
    """Targets that share total (all sizes by default) by weight; a source stops at most times its size, and what is over goes to the others by weight until none is above."""
    left = float(sum(sizes)) if total is None else float(total)
    out, open_ = [0.0] * len(sizes), [k for k in range(len(sizes)) if sizes[k] > 0]
    while open_:
        share = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if share * weights[k] > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = share * weights[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in over]
    return out


def cycling_weights(n: int, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[float]:
    return [cycle[k % len(cycle)] for k in range(n)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of drawn units, taken without replacement, are among the good; at any count.

    numpy draws below 10**9 units. Beyond, the same law by inversion: probabilities follow from the mode outwards by
    their exact ratios, as far as 14 deviations, where what is left is under the resolution of a uniform draw.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    spread = int(14 * np.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1)))) + 60
    lo, hi = max(0, drawn - bad, mode - spread), min(good, drawn, mode + spread)
    mode = min(max(mode, lo), hi)
    up, down = np.arange(mode, hi, dtype=np.float64), np.arange(mode, lo, -1, dtype=np.float64)
    up = np.cumprod((good - up) / (up + 1) * ((drawn - up) / (bad - drawn + up + 1)))
    down = np.cumprod(down / (good - down + 1) * ((bad - drawn + down) / (drawn - down + 1)))
    weight = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return lo + min(int(np.searchsorted(weight, rng.random() * weight[-1], side="right")), hi - lo)


def split_quotas(quotas: np.ndarray, level: int, node: int, seed: int) -> np.ndarray:
    """The units of each source that go left at a node: half of all (rounded up), drawn without replacement, so the sources' shares are multivariate hypergeometric."""
    rng = np.random.Generator(np.random.Philox(key=[seed, level << 48 | node]))
    left, rest = np.zeros_like(quotas), int(quotas.sum())
    wanted = -(-rest // 2)
    for k in np.flatnonzero(quotas).tolist():
        rest -= int(quotas[k])
        left[k] = hypergeometric(rng, int(quotas[k]), rest, wanted)
        wanted -= int(left[k])
    return left


def leaf_quotas(quotas: np.ndarray, leaf: int, depth: int, seed: int, path: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first unit and number of units of each source that a leaf of the tree gets.

    A node's draw depends on the seed and its place alone: a leaf walks down by itself, and all leaves agree.
    path: what the walk before left behind; the part of the way that both share isn't drawn again.
    """
    path = [] if path is None else path
    if not path:
        path.append((0, np.zeros(len(quotas), dtype=np.int64), np.asarray(quotas, dtype=np.int64)))
    for level in range(1, depth + 1):
        node = leaf >> depth - level
        if level < len(path) and path[level][0] == node:
            continue
        del path[level:]
        above, first, q = path[-1]
        left = split_quotas(q, level - 1, above, seed)
        path.append((node, first + left, q - left) if node & 1 else (node, first, left))
    return path[depth][1:]


def plan_mix(docs: DataFrame, source_column: str = "source", text_column: str = "text", cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, block_words: int = 1 << 20, shard_words: int = 1 << 22, seed: int = 7, most_sources: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plan a mix: (documents, units drawn, picked documents, sources).

    sources: source, none (it was null), source_size, target. Blocks: a document belongs to one of
    ceil(source_size / block_words) random blocks of its source, by a hash of its content. A source is taken in whole
    passes over its blocks and one more over part of them; the pass ends inside one block, of which documents are
    picked in random order as they fit. Every drawn block of a pass is a unit; sources' units are parted exactly among
    output shards by the splitting tree, and each shard gets disjoint ranges of them.

    documents: row (a struct of all columns of docs), size, source (never null), none, key (hash of the content),
    block. units: source, none, block, pass, shard, full. picked: source, none, block, key of the documents taken
    where a unit isn't full; documents without words are never picked. Null texts have size 0; rows with one
    doc_id, source and text are picked together. Empty docs give empty tables. More than most_sources sources
    raise ValueError: their quotas travel with the tree.
    """
    spark = docs.sparkSession
    content = [F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", source_column, text_column)]
    source = F.col(source_column)
    keyed = common.as_row(
        docs, common.n_words(F.col(text_column)).alias("size"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), source.isNull().alias("none"),
        F.xxhash64(F.lit(seed), *content).alias("key"),
    )
    narrow = common.written(keyed.select("source", "none", "key", "size"), "mix-sizes")
    sums = narrow.groupBy("source", "none").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"over {most_sources} sources")
    # Code point order is the order of UTF-8 bytes; null comes last.
    sums = sorted(sums, key=lambda r: (r["none"], r["source"].encode()))
    sizes = [int(r["size"]) for r in sums]
    goals = targets(sizes, cycling_weights(len(sums), cycle), None, most)
    rows = [(k, r["source"], r["none"], size, goal, max(1, -(-size // block_words))) for k, (r, size, goal) in enumerate(zip(sums, sizes, goals, strict=True))]
    sources = spark.createDataFrame(rows, "rank int, source string, none boolean, source_size long, target double, blocks long")
    its, of_block = ["source", "none"], ["source", "none", "block"]

    def blocked(df: DataFrame) -> DataFrame:
        by = sources.select(*its, "blocks")
        return df.join(F.broadcast(by) if len(rows) <= 100_000 else by, its).withColumn("block", F.pmod("key", "blocks")).drop("blocks")

    blocks = common.written(blocked(narrow).groupBy(of_block).agg(F.sum("size").alias("words")), "mix-blocks")
    # What a source still needs after whole passes; blocks are taken in order of their number, which is random in itself.
    want = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    want = want.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).drop("blocks")
    by = Window.partitionBy(its)
    before = F.coalesce(F.sum("words").over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumns({"before": before, "at": F.row_number().over(by.orderBy("block")) - 1, "present": F.count(F.lit(1)).over(by)}).join(want, its)
    placed = placed.withColumn("more", F.when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    placed = common.written(placed, "mix-placed")
    cut = placed.where("more = 1").select(*of_block, (F.col("rest") - F.col("before")).alias("needed"))
    inside = blocked(narrow.where("size > 0")).join(cut, of_block).groupBy(*of_block, "needed", "key").agg(F.sum("size").alias("size"))

    def fit(pdf):
        pdf = pdf.sort_values("key", ignore_index=True)
        needed, chosen, best = float(pdf["needed"].iloc[0]), [], None
        for at, size in enumerate(pdf["size"].tolist()):
            if size <= needed:
                chosen.append(at)
                needed -= size
            elif best is None or size < best[0]:
                best = (size, at)
        if best and best[0] - needed < needed:  # going over by less than is missing
            chosen.append(best[1])
        return pdf.loc[chosen, [*of_block, "key"]]

    picked = common.written(inside.groupBy(of_block).applyInPandas(fit, "source string, none boolean, block long, key long"), "mix-picked")
    # Units of a source are numbered pass by pass, and in a pass by block.
    unit = placed.withColumn("pass", F.explode(F.expr("sequence(0L, passes)"))).where("pass < passes OR more > 0")
    unit = unit.select("rank", *of_block, "pass", (F.col("pass") * F.col("present") + F.col("at")).alias("place"), ((F.col("pass") < F.col("passes")) | (F.col("more") == 2)).alias("full"))
    unit = common.written(unit, "mix-units")
    quotas_of = {r["rank"]: r["n"] for r in unit.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = np.array([quotas_of.get(k, 0) for k in range(len(rows))], dtype=np.int64)
    depth = max(0, int(np.ceil(np.log2(max(1.0, sum(goals) / shard_words)))))

    def leaves(batches):
        import pyarrow as pa

        path: list = []
        for batch in batches:
            for leaf in batch.column(0).to_pylist():
                first, n = leaf_quotas(quotas, leaf, depth, seed, path)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), leaf)), pa.array(first[some]), pa.array(n[some])], names=["rank", "shard", "lo", "n"])

    deals = spark.range(1 << depth).mapInArrow(leaves, "rank int, shard long, lo long, n long")
    deals = deals.select("rank", "shard", F.explode(F.expr("sequence(lo, lo + n - 1)")).alias("place"))
    # The places of a source have no gaps: whole passes fill blocks that are there times passes, and the last pass begins at the first.
    units = common.written(unit.join(deals, ["rank", "place"]).select(*of_block, "pass", "shard", "full"), "mix-dealt")
    common.discard(blocks, placed, unit, narrow)
    return blocked(keyed), units, picked, sources.drop("blocks", "rank")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target (of its source), taken (the words of the document in the mix, repeats counted) and shards (those that hold it, one entry for each time).

    What is taken is what the leaves of the splitting tree hold. Null texts have size 0, and are taken with 0 words;
    null sources are one source. Rows equal in doc_id, source and text are taken alike. Empty table: no row.
    Columns of docs with those names are replaced; others pass through, whatever they are called.
    """
    columns = common.without(docs.columns, "size", "source_size", "target", "taken", "shards")
    keyed, units, picked, sources = plan_mix(docs, **how)
    of_block = ["source", "none", "block"]
    draws = common.written(units.groupBy(of_block).agg(F.collect_list(F.struct("shard", "full")).alias("draws")), "mix-draws")  # at most a few passes
    joined = keyed.join(draws, of_block, "left").join(picked.withColumn("picked", F.lit(True)), [*of_block, "key"], "left")
    joined = joined.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, ["source", "none"])
    held = F.expr("array_sort(transform(filter(coalesce(draws, array()), d -> d.full or coalesce(picked, false)), d -> d.shard))")
    joined = joined.withColumn("shards", held)
    return joined.select(*common.row_columns(columns), "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as they are taken, in shards by the splitting tree, shuffled in each.

    A shard is ordered by a hash of document and pass, and lies in 64 slices of that order, so its tasks stay small.
    Columns are those of docs, whatever they are called. Null and empty texts go with blocks that are taken whole;
    repeated rows are taken alike. Empty table: no row.
    """
    keyed, units, picked, _ = plan_mix(docs, seed=seed, **how)
    of_block = ["source", "none", "block"]
    drawn = keyed.join(units, of_block).join(picked.withColumn("picked", F.lit(True)), [*of_block, "key"], "left").where("full OR picked")
    placed = drawn.withColumn("turn", F.xxhash64("key", "pass", F.lit(seed + 1)))
    shuffled = placed.repartition(F.col("shard"), F.shiftrightunsigned("turn", 58)).sortWithinPartitions("shard", "turn")
    return shuffled.select(*common.row_columns(docs.columns))

"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 60


def hash_bits(column) -> F.Column:
    """The first 60 bits of the MD5 of a value's text, as a long; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Leaves of the directory: depth, prefix, bytes, n and whole (false if the bucket can't split further and is over limit).

    sized: _hash, _bytes. Starting from depth 0, buckets over limit split on the next bit until every one fits.
    A round looks at step further bits at once: cells of that depth are sums that combine before the shuffle,
    each cell counts for all its prefixes, and a leaf is a prefix that fits under a parent that doesn't. Only cells of buckets that are
    still oversized go into the next round, so the rounds' sizes follow the shards. Buckets whose rows all share one hash stay over.
    """
    cells = common.written(sized.groupBy("_hash").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-cells")
    total = cells.agg(F.sum("bytes")).first()[0]
    spark, leaves, base, open_ = sized.sparkSession, None, 0, None
    if total is None:
        return spark.createDataFrame([], "depth int, prefix long, bytes long, n long, whole boolean")
    while True:
        # The first round goes as deep as even buckets would need, and step bits beyond.
        deep = min(BITS, base + step + (max(0, int(total // max(1, limit))).bit_length() if base == 0 else 0))
        at = cells.withColumn("_top", F.shiftright("_hash", BITS - base))
        if open_ is not None:
            at = at.join(open_, at._top == open_.prefix, "left_semi")
        fine = at.groupBy(F.shiftright("_hash", BITS - deep).alias("_cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        spread = fine.select("bytes", "n", F.explode(F.expr(f"transform(sequence({base}, {deep}), d -> struct(d AS depth, shiftright(_cell, {deep} - d) AS prefix))")).alias("p"))
        sums = common.written(spread.groupBy("p.depth", "p.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "shard-sums")
        over = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        root = fits.where("depth = 0")
        child = fits.withColumn("_parent", F.shiftright("prefix", 1)).join(over, ["depth", "_parent"], "left_semi").select(sums.columns)
        found = root.unionAll(child).withColumn("whole", F.col("bytes") <= limit)
        leaves = found if leaves is None else leaves.unionAll(found)
        open_ = common.written(sums.where((F.col("bytes") > limit) & (F.col("depth") == deep)).select("prefix"), "shard-open")
        if deep == BITS or open_.isEmpty():
            return common.written(leaves.select(F.col("depth").cast("int").alias("depth"), "prefix", "bytes", "n", "whole"), "shard-directory")
        base = deep


def assign_shards(docs: DataFrame, limit: int, key_column: str = "doc_id", text_column: str = "text", lot_shards: int = 64) -> DataFrame:
    """docs with n_bytes (of the text in UTF-8, 0 for null), shard (the bits of its prefix; "" for the whole hash space) and shard_bytes.

    Every shard holds at most limit bytes. Rows that share one hash can't be parted by bits: if they are over limit
    together they are dealt into lots of about lot_shards shards by their place in the input, and each lot fills
    overflow pages in order of size, "<bits>+<lot>.<page>", each within limit unless one text alone is over. So no
    task holds more than a lot, even if all keys are null or equal. Null keys hash like the empty text; repeated rows
    count as often as they occur. Empty tables stay empty. Columns of docs with those names are replaced; others
    pass through, whatever they are called.
    """
    columns = common.without(docs.columns, "n_bytes", "shard", "shard_bytes")
    sized = common.as_row(docs, F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(key_column)).alias("_hash"), F.monotonically_increasing_id().alias("place"))
    leaves = directory(sized.select("_hash", F.col("n_bytes").alias("_bytes")), limit)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    named = leaves.select("depth", "prefix", bits.alias("shard"), F.col("bytes").alias("shard_bytes"), "whole")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61
    # A row has one candidate prefix for each depth that occurs; exactly one of them is a leaf.
    tried = ", ".join(f"struct({d} AS depth, shiftright(_hash, {BITS - d}) AS prefix)" for d in sorted(depths)) or "struct(0 AS depth, 0L AS prefix)"
    hashes = sized.select("_hash").distinct().select("_hash", F.explode(F.expr(f"array({tried})")).alias("p")).select("_hash", "p.depth", "p.prefix")
    placed = common.written(hashes.join(named, ["depth", "prefix"]).select("_hash", "shard", "shard_bytes", "whole"), "shard-of-hash")
    out = sized.join(placed, "_hash")
    names = [*common.row_columns(columns), "n_bytes", "shard", "shard_bytes"]
    if placed.where("NOT whole").isEmpty():
        return out.select(names)
    half = max(1, limit // 2)
    lots = F.ceil(F.col("shard_bytes") / (lot_shards * max(1, limit)))
    dealt = out.where("NOT whole").withColumn("lot", F.pmod(F.xxhash64("place"), F.greatest(lots, F.lit(1))))
    own = Window.partitionBy("_hash", "lot").orderBy("n_bytes", "place")
    before = F.coalesce(F.sum("n_bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Half-full at worst: a page ends where the next text would begin beyond half the limit.
    page = F.when(F.col("n_bytes") > half, F.concat(F.lit("t"), F.row_number().over(own))).otherwise(F.floor(before / half).cast("string"))
    pages = dealt.withColumn("page", page).withColumn("shard", F.concat("shard", F.lit("+"), "lot", F.lit("."), "page"))
    pages = pages.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard")))
    return out.where("whole").select(names).unionAll(pages.select(names))


def write_shards(docs: DataFrame, path: str, limit: int, key_column: str = "doc_id", text_column: str = "text") -> None:
    """Write docs under path, one folder shard=b<bits> for each shard. Nulls, ties, repeats and clashing names as in assign_shards(); an empty table writes no shard."""
    assigned = assign_shards(docs, limit, key_column, text_column).withColumn("shard", F.concat(F.lit("b"), "shard"))
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)

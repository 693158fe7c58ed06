"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors and queries with a component beyond this size are scored in whole numbers of any length, without the index.
WIDE = float(1 << 40)
#: Shares of a block's postings after which candidates are counted.
STEPS = (0.3, 0.45, 0.55, 0.65, 0.8, 1.0)
#: A posting segment with at least this share of a block's vectors is kept as an array over all of them, else as a list.
DENSE = 1 / 32
#: Components that a block holds at most (or one vector): its layers take some 50 bytes for each.
COMPONENTS = 1 << 19


def quantised(values: DataFrame, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and v, the vector of floor(scale * x), whole numbers of any size as doubles.

    Vectors null, or with a null or non-finite component, are left out; empty vectors and null ids stay. scale is a
    power of two, so nothing is rounded. A finite component that scale takes beyond the doubles raises an error.
    """
    # floor() gives a long: beyond 2**53 a double is a whole number already.
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    v = F.transform(F.col(vector_column), lambda x: whole(x.cast("double") * scale))
    sound = F.col(vector_column).isNotNull() & F.forall(vector_column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return values.where(sound).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


class Found(NamedTuple):
    """Results: ids, whether an id is null, and exact scores (longs, or whole numbers of any length)."""

    ids: np.ndarray
    none: np.ndarray
    scores: np.ndarray

    def best(self, k: int) -> Found:
        """The k highest scores, ties to the smaller id, null last."""
        by_id = np.lexsort((self.ids, self.none))
        order = by_id[np.argsort(-self.scores[by_id], kind="stable")[:k]]
        return Found(*(x[order] for x in self))

    def plus(self, other: Found) -> Found:
        return Found(*(np.concatenate(x) for x in zip(self, other, strict=True)))


NOTHING = Found(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def exact_scores(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: in doubles or longs where no sum can leave their exact range, else of any length."""
    bound = float(np.abs(matrix).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if bound < 1 << 53:
        return (matrix @ query).astype(np.int64)
    if bound < 1 << 62:
        return matrix.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query.tolist()]
    out = np.empty(len(matrix), dtype=object)
    out[:] = [sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in matrix.tolist()]
    return out


class Block:
    """Vectors as posting segments: for each dimension the vectors in falling order of impact (a component's size), cut where a layer ends.

    A layer holds the segments of all dimensions between two impacts; layers run from the highest impact down. Long
    segments of a layer stand side by side as arrays over all vectors and are scored in one product, short ones are
    lists of postings. Beside them stand, for each vector and layer, the norm of what is still to come and the number
    of its components.
    """

    def __init__(self, ids: np.ndarray, none: np.ndarray, matrix: np.ndarray):
        self.ids, self.none, self.matrix = ids, none, matrix
        size = np.abs(matrix)
        self.wild = np.flatnonzero(size.max(axis=1, initial=0) > WIDE)
        self.tame = np.flatnonzero(size.max(axis=1, initial=0) <= WIDE)
        size, signed = size[self.tame], matrix[self.tame]
        impacts = np.sort(size, axis=None)[::-1]
        total = max(1, int(np.count_nonzero(impacts)))
        # Impacts at which layers end; equal impacts share a layer.
        ends = sorted({float(impacts[min(total, int(np.ceil(s * total))) - 1]) for s in STEPS[:-1]} | {1.0}, reverse=True) if impacts.size else []
        self.layers, above = [], np.inf
        order = np.argsort(-size, axis=0, kind="stable")
        self.postings = int(np.count_nonzero(size))
        for least in [e for e in ends if e >= 1]:
            lo, hi = np.count_nonzero(size >= above, axis=0), np.count_nonzero(size >= least, axis=0)
            long_ = np.flatnonzero(hi - lo >= max(1, DENSE * len(size)))
            in_layer = (size[:, long_] >= least) & (size[:, long_] < above)
            arrays = (long_, np.where(in_layer, signed[:, long_], 0.0))
            lists = [(d, at, signed[at, d]) for d in np.flatnonzero(lo < hi).tolist() if hi[d] - lo[d] < DENSE * len(size) for at in [order[lo[d] : hi[d], d]]]
            to_come = np.where(size < least, size, 0.0)
            self.layers.append((arrays, lists, int((hi - lo).sum()), np.sqrt((to_come**2).sum(axis=1)), np.count_nonzero(to_come, axis=1)))
            above = least
        self.norm = np.sqrt((size**2).sum(axis=1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: list) -> tuple[list[Found], int]:
        """For each query its k best of this block that may reach floor (the k-th best score so far, or None), exact; and the postings touched for all queries.

        Scores gather layer by layer. What is still to come for a vector is at most the norm of its open components
        times the norm of as many of the query's largest ones. Candidates are the vectors whose upper bound reaches
        the k-th best lower bound and floor; nothing else can be among the best. A query stops when to rescore its
        candidates costs less than the next layer's postings, or after the last layer.
        """
        out: list[Found | None] = [None] * len(queries)
        wide = np.abs(queries).max(axis=1, initial=0) > WIDE
        live, touched, n, width = np.flatnonzero(~wide), 0, len(self.tame), queries.shape[1]
        q = queries[live].T
        known = np.zeros((n, len(live)))
        norms = np.sqrt((q**2).sum(axis=0))
        heads = np.sqrt(np.concatenate([np.zeros((1, len(live))), np.cumsum(-np.sort(-(q**2), axis=0), axis=0)]))
        least = np.array([-np.inf if floor[k_] is None else float(floor[k_]) for k_ in live])
        own = (self.ids[self.tame][:, None] == query_ids[live][None, :]) & ~self.none[self.tame][:, None]
        rounding = (width + 8) * 2.3e-16

        def finish(row: int, at: np.ndarray) -> None:
            at = np.concatenate([self.tame[at], self.wild])
            at = at[(self.ids[at] != query_ids[row]) | self.none[at]]
            out[row] = Found(self.ids[at], self.none[at], exact_scores(self.matrix[at], queries[row])).best(k)

        for depth, ((long_, arrays), lists, postings, norm_left, open_) in enumerate(self.layers):
            if not len(live):
                break
            known += arrays @ q[long_]
            for d, at, values in lists:
                known[at] += values[:, None] * q[d]
            touched += postings * len(live)
            slack = heads[open_]
            slack *= norm_left[:, None]
            slack += rounding * (self.norm[:, None] * (2 * norms) + 1)
            bar = least.copy()
            unset = np.flatnonzero(least == -np.inf)
            if n >= k and len(unset):  # no floor yet: the k-th best lower bound of this block
                low = np.where(own[:, unset], -np.inf, known[:, unset] - slack[:, unset])
                bar[unset] = np.partition(low.T, n - k, axis=1)[:, n - k]
            slack += known
            possible = (slack >= bar) & ~own
            next_ = self.layers[depth + 1][2] / max(1, width) if depth + 1 < len(self.layers) else np.inf
            done = possible.sum(axis=0) <= next_
            for col in np.flatnonzero(done).tolist():
                at = np.flatnonzero(possible[:, col])
                touched += len(at) * width
                finish(live[col], at)
            live, q, known, norms, heads, least, own = live[~done], q[:, ~done], known[:, ~done], norms[~done], heads[:, ~done], least[~done], own[:, ~done]
        for row in [*live.tolist(), *np.flatnonzero(wide).tolist()]:  # no postings at all, or too wide for the index
            finish(row, np.arange(n))
        return out, touched


def blocks_of(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors (vec_id, v) packed where they lie into rows of at most rows vectors and COMPONENTS components, of one width: block (number), width, n, ids, none and values as bytes. Null ids are marked in none. Empty: no row."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, task = 0, TaskContext.get().partitionId() << 32
        names = ["block", "width", "n", "ids", "none", "values"]

        def out(width, ids, vectors):
            nonlocal n
            n += 1
            none = np.array([i is None for i in ids])
            numbers = np.array([0 if i is None else i for i in ids], "<i8")
            values = np.array(vectors, "<f8")
            if not np.isfinite(values).all():
                raise OverflowError("a quantised component is beyond the range of doubles")
            return pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([width]), pa.array([len(ids)]), *(pa.array([x.tobytes()]) for x in (numbers, none, values))], names=names)

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                vs.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == rows or len(ids) * len(v) >= COMPONENTS:
                    yield out(len(v), *held.pop(len(v)))
        for width, (ids, vs) in held.items():
            yield out(width, ids, vs)

    return common.written(vectors.select("vec_id", F.col("v").cast("array<double>")).mapInArrow(run, "block long, width long, n long, ids binary, none binary, values binary"), name)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 1024, group_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with vectors other than itself, ties to the smaller vec_id, null last.

    vectors, queries: vec_id, v (whole numbers). Query blocks form groups of at most about group_bytes. A task holds one
    group and lets its share of the vector blocks pass by: a block moves and is indexed once for each group, not
    for each query. Each query's k-th best score is the floor for the blocks after, and a task gives at most k rows
    for a query, which the final rank cuts in each task before the shuffle. Fewer than k others: all of them.
    Repeated vec_ids are several vectors; rows with the query's own id are never its results. Only equal widths
    meet. Queries need an id, and those that share one share a list. No query, no row. Other columns are ignored. A score among the best that doesn't fit a
    long raises OverflowError; any other is exact.
    """
    spark = vectors.sparkSession
    corpus = blocks_of(vectors, block_rows, "topk-vectors")
    asked = blocks_of(queries.where("vec_id IS NOT NULL"), query_rows, "topk-queries")
    # Groups of queries of one width, numbered through; a row here stands for a thousand queries.
    size = F.octet_length("values") + F.octet_length("ids") + 1
    run_ = F.sum(size).over(Window.partitionBy("width").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    grouped = asked.select("block", "width", F.floor((run_ - 1) / group_bytes).alias("part"))
    groups = grouped.select("width", "part").distinct().select("width", "part", (F.row_number().over(Window.orderBy("width", "part")) - 1).alias("qg"))
    grouped = common.written(grouped.join(groups, ["width", "part"]).select("block", "width", "qg"), "topk-groups")
    groups = grouped.select("width", "qg").distinct()
    n_groups, parts = groups.count(), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lots = max(1, -(-parts // max(1, n_groups)))
    lot = F.sequence(F.lit(0), F.lit(lots - 1))
    body = ["block", "n", "ids", "none", "values"]
    left = asked.join(grouped.select("block", "qg"), "block").select(F.lit(0).alias("kind"), "qg", F.explode(lot).alias("lot"), "width", *body)
    right = corpus.join(F.broadcast(groups) if n_groups <= 100_000 else groups, "width").select(F.lit(1).alias("kind"), "qg", F.pmod(F.xxhash64("block"), F.lit(lots)).cast("int").alias("lot"), "width", *body)

    def run(batches):
        import pyarrow as pa

        now, held = None, []

        def out():
            for ids, _, have in held:
                best = [f for f in have if len(f.ids)]
                scores = [s for f in best for s in f.scores.tolist()]
                if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
                    raise OverflowError(f"a score doesn't fit a long; queries from {ids[0]} on")
                found = [None if no else i for f in best for i, no in zip(f.ids.tolist(), f.none.tolist(), strict=True)]
                of = np.repeat(ids, [len(f.ids) for f in have])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for kind, qg, lot_, width, _, n, ids, none, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (qg, lot_) != now:
                    yield from out()
                    now, held = (qg, lot_), []
                ids, none, matrix = np.frombuffer(ids, "<i8"), np.frombuffer(none, bool), np.frombuffer(values, "<f8").reshape(n, width)
                if not kind:
                    held.append((ids, matrix, [NOTHING] * n))
                    continue
                block = Block(ids, none, matrix)
                for q_ids, q, have in held:
                    for lo in range(0, len(q_ids), 128):
                        part = slice(lo, lo + 128)
                        floor = [f.scores[-1] if len(f.ids) >= k else None for f in have[part]]
                        found, _ = block.search(q_ids[part], q[part], k, floor)
                        have[part] = [a.plus(b).best(k) for a, b in zip(have[part], found, strict=True)]
        yield from out()

    both = left.unionAll(right).withColumn("task", (F.col("qg") * lots + F.col("lot")).cast("int"))
    met = both.repartitionById(max(1, n_groups * lots), "task").sortWithinPartitions("qg", "lot", "kind", "block").drop("task")
    found = met.select("kind", "qg", "lot", "width", *body).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

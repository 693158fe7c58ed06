"""SimHash fingerprints, and the documents that link within a Hamming radius, by covering locality-sensitive hashing.

Covering: give every bit of a fingerprint a non-zero vector of radius + 1 bits. The mask of a non-zero vector v
keeps those bits whose vector has odd inner product with v; there are 2**(radius + 1) - 1 masks. The vectors of
the at most radius bits in which a pair differs span a proper subspace, so some v is orthogonal to all of them,
and under v's mask the pair is equal. Every pair within the radius thus meets in some table.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64


def covering_masks(radius: int, seed: int) -> list[int]:
    """2**(radius + 1) - 1 masks of 64 bits, each of about 32."""
    n = (1 << radius + 1) - 1
    vectors = 1 + np.random.default_rng([seed, radius]).permutation(BITS) % n
    return [int(sum(1 << bit for bit in range(BITS) if bin(int(vectors[bit]) & v).count("1") & 1)) for v in range(1, n + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of u64 hashes: a bit is 1 if set in over half of them; 0 for none."""
    total = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """All runs of width words, joined by spaces, repeats included; of fewer words the whole sequence; of none nothing."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = [0, *(ends[:-width] + 1).tolist()]
    return [joined[a:b] for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)]


def hashed(parts: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(p, seed) for p in parts), dtype="<u8", count=len(parts))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (long, the bits of an unsigned 64-bit integer) of every row, in the place it lies.

    Words: runs of other than the six ASCII white-space characters, A-Z lower-cased. Null or empty text: fp 0.
    """

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            fps = [majority(hashed(shingles((t or b"").lower().split(), width), seed)) for t in common.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(run, "doc_id long, fp long")


def bucketed(rows: DataFrame, radius: int, seed: int, extra: str | None = None) -> DataFrame:
    """rows (fp, ...) once for each mask, with bucket: a hash of mask number, kept bits and the column extra."""
    masks = covering_masks(radius, seed)
    within = f"{extra}, " if extra else ""
    keys = ", ".join(f"xxhash64({within}{k}, fp & {signed(m)}L)" for k, m in enumerate(masks))
    return rows.withColumn("bucket", F.explode(F.expr(f"array({keys})")))


def near(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (position, position of a member nearer the root) that join those of fps that chains of links within the radius join."""
    n, edges = len(fps), []
    left = np.arange(1, n)
    front = [0]
    while True:
        while front and len(left):
            at = front.pop()
            hit = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            found = left[hit]
            edges += [(int(k), at) for k in found]
            front += found.tolist()
            left = left[~hit]
        if not len(left):
            return edges
        front, left = [int(left[0])], left[1:]


def shared_only(rows: DataFrame) -> DataFrame:
    """rows (bucket and further columns) less those alone in their bucket, but for a few at the borders of tasks.

    Ranges of bucket and the next column part even one bucket with all rows; in order, a row has company if a neighbour has its bucket.
    """

    def run(batches):
        import pyarrow as pa

        last, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            same = bucket[1:] == bucket[:-1]
            keep = np.append(False, same) | np.append(same, False)
            if last is not None and (first or last[1] or last[0].column(0)[0].as_py() == bucket[0]):
                yield last[0]
                first = False
            keep[0] |= last is None or last[0].column(0)[0].as_py() == bucket[0]
            # Whether the last row has company shows in the next batch.
            last = (batch.slice(len(bucket) - 1), bool(keep[-1]))
            keep[-1] = False
            yield batch.filter(pa.array(keep))
        if last is not None:
            yield last[0]

    by = rows.columns[:2]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, rows.schema)


def links(fps: DataFrame, radius: int, seed: int = 1, most: int = 2000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within radius.

    fps: distinct column fp. A bucket gives a spanning forest of its links, never its pairs. A bucket with more
    than most members is split again by masks over the bits that its members may differ in; after three rounds
    some eight free bits are left, so no bucket is large. No pair is lost at any size.
    """
    schema = "a long, b long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                part = np.sort(np.array(members, dtype=np.int64))
                for i, j in near(part.view(np.uint64), radius):
                    a.append(int(part[i]))
                    b.append(int(part[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows, found, depth = bucketed(fps.select("fp"), radius, seed), None, 0
    while True:
        shared = common.written(shared_only(rows.select("bucket", "fp")), f"simhash-shared-{depth}")
        counts = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = common.written(shared.join(counts, "bucket").select("fp", "bucket", "members"), f"simhash-buckets-{depth}")
        common.discard(shared)
        small = met if depth == 2 else met.where(F.col("members") <= most)
        edges = small.groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, schema)
        found = edges if found is None else found.unionAll(edges)
        large = met.where(F.col("members") > most)
        depth += 1
        if depth > 2 or large.isEmpty():
            return found
        rows = bucketed(large.withColumnRenamed("bucket", "outer"), radius, seed + depth, "outer")


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that chains of links reach.

    Fingerprints link at radius or fewer differing bits; equal ones always. Only distinct fingerprints are
    compared, so copies cost one row. Null or empty texts have fingerprint zero and link like any other. Null
    doc_ids take part, and are no component_id unless a component has no other (then it is null). Repeated rows
    are kept. Empty table: no row. Other columns are ignored.
    """
    per_doc = common.written(fingerprints(docs, width, seed, id_column, text_column), "simhash-fps")
    distinct = common.written(per_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, radius))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = common.written(labelled, "simhash-labelled")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    smallest = common.written(smallest.where("n > 1"), "simhash-groups")
    # A fingerprint alone in its component carries its own smallest doc_id; only the others need the join.
    joined = labelled.join(smallest, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return per_doc.join(joined, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """Sorted distinct u64 hashes of the text's shingles."""
    return np.unique(hashed(shingles((text or b"").lower().split(), width), seed))


def frequent(docs: DataFrame, width: int, seed: int, sample: int = 20_000, most: int = 400_000) -> np.ndarray:
    """Hashes of shingles that some sample of the texts holds three times or more, the most frequent first.

    They only set the order in which prefixes are taken: any order finds every pair, this one keeps buckets small.
    """

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            flat = np.concatenate([np.zeros(0, "<u8"), *(shingle_set(t, width, seed) for t in common.text_bytes(batch.column(0)))])
            values, counts = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    every = max(1, docs.select("digest").count() // sample)
    some = docs.where(F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(every)) == 0).select("text")
    counted = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 3")
    top = counted.orderBy(F.desc("n"), "shingle").limit(most).toArrow().column("shingle")
    return top.to_numpy().view(np.uint64)


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of u64 words: bit k is the parity of the hashes that are k modulo bits. Two differ in at most as many bits as their sets in items."""
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of parities for a modulus of 64 size, size a power of two: halves laid on each other."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


#: Words of the bitmap that every text has; texts of more shingles than half its bits have a wider one besides.
NARROW = 16


def most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Items in which sets of n and m items differ at most if they are as similar."""
    return (n + m) * (1 - similarity) / (1 + similarity) + 1e-9


def profiles(docs: DataFrame, width: int, similarity: float, seed: int, often: np.ndarray, levels: int) -> DataFrame:
    """digest, none and id of docs as they are, fp (SimHash fingerprint), n (shingles), need (how many of them a text that links must share), prefix, bits and wide (parities, null where bits are wide enough).

    prefix: the first n - need + levels shingles, the rare before the often ones, these from the rarest on. Texts that
    link share a shingle of their first n - need + 1, and a k-th of their first n - need + k.
    """
    names = ["digest", "none", "id", "fp", "n", "need", "prefix", "bits", "wide"]

    def run(batches):
        import pyarrow as pa

        common.forget()
        by_hash = np.argsort(often)
        known = np.append(often[by_hash], np.uint64(2**64 - 1))
        place = np.append(len(often) - by_hash, 0)
        for batch in common.slices(batches):
            fps, n, need, firsts, bits, wide = [], [], [], [], [], []
            for t in common.text_bytes(batch.column(3)):
                each = hashed(shingles((t or b"").lower().split(), width), seed)
                own = np.unique(each)
                at = np.searchsorted(known[:-1], own)
                order = np.argsort(np.where(known[at] == own, place[at], 0), kind="stable")
                fps.append(majority(each))
                n.append(len(own))
                need.append(int(np.ceil(similarity * len(own) - 1e-9)))
                # Texts without a shingle link with each other: they share the shingle 0.
                firsts.append(own[order[: n[-1] - need[-1] + levels]].view(np.int64) if n[-1] else np.zeros(1, np.int64))
                words = parities(own, max(64 * NARROW, 1 << (2 * n[-1]).bit_length()))
                bits.append(folded(words, NARROW).tobytes())
                wide.append(words.tobytes() if len(words) > NARROW else None)
            offsets = pa.array(np.cumsum([0, *map(len, firsts)]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fps, pa.array(n, pa.int32()), pa.array(need, pa.int32()), prefix, pa.array(bits, pa.binary()), pa.array(wide, pa.binary())], names=names)

    schema = "digest binary, none boolean, id long, fp long, n int, need int, prefix array<long>, bits binary, wide binary"
    return docs.select("digest", "none", "id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """node and shingles (sorted distinct u64 hashes, as bytes) of every row of docs (node, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            sets = [shingle_set(t, width, seed).tobytes() for t in common.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def may_link(node: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of different roots that sizes and parities let link; rows are in order of root."""
    begins = np.searchsorted(root, root)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(int(np.searchsorted(root, root[0], "right")), len(node)):
        to = begins[i]
        j = np.flatnonzero(np.minimum(n[:to], n[i]) >= similarity * np.maximum(n[:to], n[i]) - 1e-9)
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[apart <= most_apart(n[j], n[i], similarity)]
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def possible(pairs: DataFrame, per_text: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes that sizes and parities let link; the others' shingles need not be read."""

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            n, m = (batch.column(c).to_numpy() for c in (2, 4))
            close = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
            xs, ys = (batch.column(c).to_pylist() for c in (3, 5))
            apart = np.zeros(len(n), np.int64)
            for k in np.flatnonzero(close).tolist():
                x, y = np.frombuffer(xs[k], np.uint64), np.frombuffer(ys[k], np.uint64)
                size = min(len(x), len(y))
                apart[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(close & (apart <= most_apart(n, m, similarity))))

    bits = F.coalesce("wide", "bits")
    left = per_text.select(F.col("node").alias("a"), F.col("n").alias("n"), bits.alias("x"))
    right = per_text.select(F.col("node").alias("b"), F.col("n").alias("m"), bits.alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def company(bucket: np.ndarray, n: np.ndarray, probe: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of whole buckets, in order of bucket, n and probe, have one there that sizes let link."""
    at = np.arange(len(bucket))
    follows = bucket[1:] == bucket[:-1]
    begins = np.maximum.accumulate(np.where(np.append(True, ~follows), at, 0))
    # The nearest shorter text that is indexed, and (for an indexed one) the nearest longer text, fit best.
    indexed = np.append(-1, np.maximum.accumulate(np.where(~probe, at, -1))[:-1])
    close = lambda small, large: small >= similarity * large - 1e-9
    return (indexed >= begins) & close(n[indexed], n) | ~probe & np.append(follows & close(n[:-1], n[1:]), False)


def meeting(per_text: DataFrame, similarity: float) -> DataFrame:
    """bucket and node of the shingles of prefixes, less rows that no text in their bucket can link with; a task keeps those of its first and last bucket.

    Of two texts that link, the first shingle that they share lies in the prefix of the longer one and in the shorter
    one's first n - 2 s / (1 + s) n + 1, its index part. So rows beyond that (probe) only meet shorter texts.
    Ranges of bucket, n and node part even one bucket with all rows.
    """

    def run(batches):
        import pyarrow as pa

        def out(rows, border):
            bucket, n, probe = rows.column("bucket").to_numpy(), rows.column("n").to_numpy(), rows.column("probe").to_numpy()
            keep = company(bucket, n, probe, similarity)
            for b in border:
                keep |= bucket == b
            yield from rows.select(["bucket", "node"]).filter(pa.array(keep)).to_batches()

        held, first = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            first = bucket[0] if first is None else first
            # The last bucket of a batch may go on in the next one.
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last or held and held[-1].column(0)[0].as_py() != bucket[0]:
                yield from out(pa.Table.from_batches([*held, batch.slice(0, last)]), [first])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out(pa.Table.from_batches(held), [first, held[0].column(0)[0].as_py()])

    indexed = F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-9)
    rows = per_text.select("n", "node", F.posexplode(F.slice("prefix", F.lit(1), F.col("n") - F.col("need") + 1)).alias("at", "bucket"))
    rows = rows.select("bucket", "n", (F.col("at") >= F.col("n") - indexed + 1).alias("probe"), "node")
    order = ["bucket", "n", "probe", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "bucket long, node long")


def crossing(rows: DataFrame, name: str) -> DataFrame:
    """rows (node, bucket, root and further columns) of buckets in which several roots meet, with members and hub (node and root, the foremost in an order that all buckets share)."""
    hub = F.max(F.struct(F.xxhash64("node").alias("turn"), "node", "root")).alias("hub")
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"), hub).where("lo <> hi")
    return common.written(rows.join(buckets.drop("lo", "hi"), "bucket"), name)


def pairs_apart(apart: DataFrame, per_text: DataFrame, similarity: float, most: int, levels: int, whole_buckets: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a bucket and may link, with more.

    apart: what crossing() gives. All such pairs, if whole_buckets; else a bucket with many pairs for its members gives
    one for each member, and its number in more: once those are linked, few pairs of different roots are left. A bucket of over most members is split by a further shingle that texts which link
    must share; what is still large after levels shingles is cut in parts of about most members, and every part
    meets every other in a task of its own. Only pairs that sizes and parities let link leave a task.
    """

    def run(batches):
        import pyarrow as pa

        def out(a, b, more):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([more] * len(a), pa.int64())], names=["a", "b", "more"])

        def compare(rows):
            bucket, top, node, root, n = (rows.column(c).to_numpy() for c in ("bucket", "top", "node", "root", "n"))
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                i, j = may_link(node[lo:hi], root[lo:hi], n[lo:hi], bits[lo:hi], similarity)
                more = None
                if not whole_buckets and len(i) > max(32, 2 * (hi - lo)):
                    first = np.unique(i, return_index=True)[1]
                    i, j, more = i[first], j[first], int(top[lo])
                for k in range(0, len(i), 100_000):
                    yield out(node[lo + i[k : k + 100_000]], node[lo + j[k : k + 100_000]], more)

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            # The last bucket of a batch may go on in the next one.
            last = int(np.searchsorted(bucket, bucket[-1]))
            if held and last:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield from compare(pa.Table.from_batches([batch.slice(0, last)]))
            elif held and held[-1].column(0)[0].as_py() != bucket[0]:
                yield from compare(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from compare(pa.Table.from_batches(held))
        common.trim()

    found, apart = None, apart.withColumn("top", F.col("bucket"))
    for level in range(1, levels + 1):
        if level == levels:
            # One part alone meets itself.
            parts = F.ceil(F.col("members") / most)
            own = F.pmod(F.xxhash64("node", F.lit(level)), parts)
            whole = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            whole = whole.withColumn("bucket", F.when(parts > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket")))
        else:
            whole = apart.where(F.col("members") <= most)
        whole = whole.select("node", "bucket", "root", "top").join(per_text.select("node", "n", "bits"), "node").select("bucket", "root", "node", "n", "bits", "top")
        pairs = whole.repartition("bucket").sortWithinPartitions("bucket", "root", "node").mapInArrow(run, "a long, b long, more long")
        found = pairs if found is None else found.unionAll(pairs)
        crowded = apart.where(F.col("members") > most)
        if level == levels or crowded.isEmpty():
            return found
        # Texts that need no further shingle also stay together.
        further = f"filter(transform(prefix, (s, k) -> struct(s, cast(k as int) as k)), e -> e.k > at and e.k < n - need + {level + 1})"
        further = f"concat({further}, if(need <= {level}, array(struct(0L as s, at as k)), array()))"
        at = F.expr("cast(array_position(prefix, bucket) - 1 as int)") if level == 1 else F.col("at")
        split = crowded.drop("members", "hub").join(per_text.select("node", "n", "need", "prefix"), "node").withColumn("at", at)
        split = split.select("node", "bucket", "root", "top", F.explode(F.expr(further)).alias("e"))
        apart = crossing(split.select("node", F.expr("xxhash64(bucket, e.s)").alias("bucket"), F.col("e.k").alias("at"), "root", "top"), f"near-apart-{level}")


def jaccard_at_least(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets of shingles (64-bit hashes stand for them) have at least this Jaccard similarity; two empty sets are equal."""
    threshold = similarity

    def run(batches):
        import pyarrow as pa

        for batch in common.slices(batches, 200):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def covered_pairs(per_text: DataFrame, radius: int, seed: int) -> DataFrame:
    """Pairs (node, other) that join all texts whose fingerprints chains of the covering tables' links join."""
    first = per_text.groupBy("fp").agg(F.min("node").alias("node"))
    edges = links(first, radius, seed)
    ends = edges.join(first.select(F.col("fp").alias("a"), "node"), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("other")), "b").select("node", "other")
    same = per_text.select("node", "fp").join(first.select("fp", F.col("node").alias("other")), "fp").where("node <> other").select("node", "other")
    return ends.unionAll(same)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, radius: int = 4, most: int = 2000, levels: int = 3, turns: int = 1) -> DataFrame:
    """digest, own (none and id of the least row) and root of each distinct text; texts of one root are near duplicates, in groups by chains of links.

    docs: digest (of the text), none and id (what orders rows of one text), text (null: empty). Texts link at a
    Jaccard similarity of their sets of width-word shingles of at least similarity, computed exactly; roots are
    those of all links, none is lost. First SimHash fingerprints of those shingles meet in the covering tables of
    radius: that joins most copies with few edits. A similarity of 0.8 lies some ten bits apart, beyond any
    radius that a covering can pay for, so the rest meets in buckets of the shingles of prefixes, as all texts that
    link do (prefix filter): in larger ones each text is compared with the foremost, which joins most of what is
    left by few pairs; then with others of other groups, all of them where they are few, else one at a time for turns
    rounds or until nothing links, and at last all. Texts without words link with each other. Empty: no row. Texts stay where they lie but for those that are compared.
    """
    each = profiles(docs, width, similarity, seed, frequent(docs, width, seed), levels)
    shape = F.struct("fp", "n", "need", "prefix", "bits", "wide")
    each = each.groupBy("digest").agg(F.min(F.struct("none", "id")).alias("own"), F.first(shape).alias("shape"))
    per_text = common.written(each.select(F.monotonically_increasing_id().alias("node"), "digest", "own", "shape.*"), "near-profiles")
    met = common.written(meeting(per_text, similarity), "near-buckets")
    spent, found, roots, turn = [met], None, None, 0
    while True:
        if not turn:
            pairs = covered_pairs(per_text, radius, seed)
        else:
            rows = met.select("node", "bucket").join(roots, "node", "left").select("node", "bucket", F.coalesce("root", "node").alias("root"))
            apart = crossing(rows if turn < 3 else rows.join(left, "bucket", "left_semi"), f"near-apart-{turn}")
            spent.append(apart)
        if turn == 1:
            pairs = apart.where((F.col("members") > 8) & (F.col("root") != F.col("hub.root"))).select("node", F.col("hub.node").alias("other"))
        if turn < 2:
            pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        else:
            # Buckets with many pairs come again, with those joined that now belong together; at last whole.
            last = turn == 2 + turns or turn > 2 and linked.isEmpty()
            met_pairs = common.written(pairs_apart(apart, per_text, similarity, most, levels, last), "near-met")
            left = common.written(met_pairs.where("more IS NOT NULL").select(F.col("more").alias("bucket")).distinct(), "near-left")
            spent += [met_pairs, left]
            pairs = met_pairs.select("a", "b").distinct()
        # Nearly all covered pairs link.
        pairs = common.written(possible(pairs, per_text, similarity) if turn else pairs, "near-pairs")
        named = per_text.select("node", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        texts = docs.select("digest", "text").join(common.written(named, "near-named"), "digest").select("node", "text").dropDuplicates(["node"])
        sets = common.written(shingle_sets(texts, width, seed), "near-sets")
        linked = common.written(jaccard_at_least(pairs, sets, similarity), "near-links")
        common.discard(sets, pairs)
        found = linked if found is None else found.unionAll(linked)
        if roots is None or not linked.isEmpty():
            roots = common.written(components(found), "near-roots")
        if turn >= 2 and (last or left.isEmpty()):
            break
        turn += 1
    out = per_text.select("node", "digest", "own").join(roots, "node", "left").select("digest", "own", F.coalesce("root", "node").alias("root"))
    out = common.written(out, "near-groups")
    common.discard(per_text, *spent)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """docs less all but one of each group of copies and near copies: the row of the smallest doc_id stays.

    Groups are the chains of near_duplicates(); equal texts (by SHA-256) always belong together, and null is the
    empty text. Null doc_ids stay only where a group has no other. Of rows equal in doc_id and text one stays.
    Columns and order of columns are those of docs, whatever else they are called; empty tables stay empty.
    """
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    keyed = common.as_row(docs, F.unhex(F.sha2(text, 256)).alias("digest"), doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), text.alias("text"))
    groups = near_duplicates(keyed.drop("row"), width, similarity, **how)
    stays = groups.groupBy("root").agg(F.min(F.struct("own", "digest")).alias("s"))
    key = ["digest", "none", "id"]
    stays = common.written(stays.select("s.digest", "s.own.none", "s.own.id"), "near-stays")
    won = keyed.drop("text").join(stays, key, "left_semi")
    # The key holds doc_id, so copies of one text part; only rows equal in both meet again, and one of them stays.
    repeated = common.written(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(key), "near-repeated")
    if not repeated.isEmpty():
        again = won.join(repeated, key, "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("turn = 1")
        won = won.join(repeated, key, "left_anti").unionAll(again.drop("turn"))
    return won.select(*common.row_columns(docs.columns))

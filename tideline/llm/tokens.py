"""Token ids: encoding, and files of frequency-ranked ids in byte-aligned variable-length code.

File format (little-endian), one file for each shard of consecutive doc_ids:

    "TIDS" | version u32 | n_docs u64 | n_tokens u64 | n_ranked u32
    | ranked ids u32[n_ranked]       rank -> id, by falling frequency in the file, ties by id
    | doc_ids i64[n_docs] | null flags u8[n_docs] | lengths u64[n_docs]
    | control bytes u8[ceil(n_tokens / 4)]   two bits for each rank: its bytes less one
    | data bytes                             each rank in 1 to 4 bytes

Control bytes stand apart from the data, so a reader looks up all lengths of four ranks at once in a
table of 256 rows, sums them to offsets, and gathers the data with numpy. A shard's own ranking needs no
pass over the whole corpus and keeps the most frequent 256 ids of the shard in one byte each.
"""

from __future__ import annotations

import struct
from itertools import islice

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC, VERSION = b"TIDS", 1
HEAD = "<4sIQQI"
#: Units and pieces whose ids a worker keeps in each of two generations: a bound on its memory.
KEPT = 500_000
#: Whole texts whose packed ids a worker keeps by SHA-256, likewise: groups of copies are encoded once.
KEPT_TEXTS = 10_000
#: Ranges of doc_id at most: their bounds travel with every task. Beyond, a range makes more files.
MOST_SHARDS = 100_000
LONG_TEXT = 1 << 20
#: Unicode's White_Space, which white space in the pattern stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern by which the vocabulary's texts are cut into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Kept(dict):
    """Results of make for the keys of late; a full generation replaces the one before, from which hits come back."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
            if len(key) > 64:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


def byte_alphabet() -> dict[str, str]:
    """Bytes as the characters by which byte-level vocabularies write them: printable ones as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """The tokenizers library over whole texts: its model's merges, called once for each distinct piece.

    The tokenizer cuts a text into pieces by its pattern before it merges bytes inside each piece, so the ids of
    a text are those of its pieces in order. No piece goes on from other characters into white space, and only
    one space leads a piece, so cutting at white space first (an optional space and what follows it up to white
    space, or white space) and then inside gives the same pieces. The first cut gives the pieces themselves where
    all is ASCII, whose letters and digits need no tables; what holds other characters is one unit, cut by the
    pattern when it is new. Ids of units and pieces are kept.
    Strings of the tokenizer's added tokens are taken out first, the longest that begins leftmost, as the library
    does by default: each is its own id, and what lies between is encoded by itself.
    """

    def __init__(self, path: str, pattern: str, kept: int = KEPT):
        import re

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merge, to_alphabet = tokenizer.model.tokenize, str.maketrans(byte_alphabet())
        #: Ids come in two bytes each where the vocabulary allows.
        self.dtype, code = ("<u2", "H") if tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

        def ids_of(piece: str) -> bytes:
            if piece.isascii():  # printable characters stand for themselves
                t = merge(piece.replace(" ", space) if piece.isprintable() else piece.translate(to_alphabet))
            else:
                t = merge(piece.encode().decode("latin1").translate(to_alphabet))
            return struct.pack(f"<{len(t)}{code}", *[x.id for x in t])

        def of_unit(unit: str) -> bytes:
            if unit.isascii() or unit.removeprefix(" ").isalpha() or len(pieces := inside(unit)) == 1:
                return ids_of(unit)
            return b"".join(map(of, pieces))

        self.added = {t.content: struct.pack(f"<{code}", k) for k, t in tokenizer.get_added_tokens_decoder().items()}
        if odd := [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
            raise ValueError(f"added tokens {odd} take their surroundings or other forms with them, which isn't supported")
        self.part = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        if pattern != PATTERN:
            raise ValueError("the cuts follow another pattern")
        inside, space = regex.compile(pattern).findall, byte_alphabet()[" "]
        self.units = Kept(of_unit, kept)
        of = self.units.__getitem__
        beyond = f"(?: |(?<![^{SPACE}]))[^{SPACE}\x80-\U0010ffff]*+[^{SPACE}\x00-\x7f][^{SPACE}]*"
        ascii_pieces = f" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}A-Za-z0-9]+"
        self.cut = re.compile(f"{beyond}|{ascii_pieces}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __call__(self, text: str | None) -> bytes:
        """Ids as bytes of dtype; none for null or empty."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if k & 1 else self.plain(x) for k, x in enumerate(self.part.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.units.__getitem__, self.cut.findall(text)))
        units, parts = (m[0] for m in self.cut.finditer(text)), []
        while some := list(islice(units, 100_000)):
            parts.append(b"".join(map(self.units.__getitem__, some)))
        return b"".join(parts)


def encoder(name: str = "byte_bpe_50k.json", kept: int = KEPT) -> Encoder:
    """The worker's encoder; name: a byte-level BPE file of the installed public tokenizers; kept: a bound on what it keeps."""

    def make():
        import public_tokenizers

        return Encoder(public_tokenizers.path(name), public_tokenizers.PATTERN, kept)

    return common.once_per_process(f"encoder {name} {kept}", make)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ranks under 2**32."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    extra = padded[:n]
    top = int(ranks.max(initial=0))
    for k in (1, 2, 3):
        if top >> 8 * k:
            extra += ranks >> np.uint32(8 * k) != 0
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    offset = np.int32 if 4 * n < 1 << 31 else np.int64
    begins = np.arange(n, dtype=offset)
    begins[1:] += np.cumsum(extra[:-1], dtype=offset)
    data = np.empty(n + int(extra.sum(dtype=np.int64)), dtype=np.uint8)
    data[begins] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        if top >> 8 * k:
            more = np.flatnonzero(extra >= k)
            data[begins[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: For each control byte the four lengths, less one.
EXTRA = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes, by table lookup."""
    extra = EXTRA[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    offset = np.int32 if 4 * n < 1 << 31 else np.int64
    begins = np.arange(n, dtype=offset)
    begins[1:] += np.cumsum(extra[:-1], dtype=offset)
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[begins].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        if not len(more):
            break
        ranks[more] |= raw[begins[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def shard_bytes(doc_ids: list, ids: list[bytes], dtype: str = "<u4") -> bytes:
    """One file's content; ids: each document's, as bytes of dtype."""
    flat = np.frombuffer(b"".join(ids), dtype)
    width = np.dtype(dtype).itemsize
    counts = np.bincount(flat) if len(flat) else np.zeros(0, dtype=np.int64)
    used = np.flatnonzero(counts)
    ranked = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = encode_ranks(rank_of[flat])
    return b"".join((
        struct.pack(HEAD, MAGIC, VERSION, len(doc_ids), len(flat), len(ranked)), ranked.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array([len(x) // width for x in ids], dtype="<u8").tobytes(), control, data,
    ))


def read_shard(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a file."""
    magic, version, n_docs, n_tokens, n_ranked = struct.unpack_from(HEAD, content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at = struct.calcsize(HEAD)
    ranked = np.frombuffer(content, "<u4", n_ranked, at)
    at += 4 * n_ranked
    doc_ids = np.frombuffer(content, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    doc_ids = [None if null else d for d, null in zip(doc_ids, content[at : at + n_docs], strict=True)]
    at += n_docs
    lengths = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    n_control = -(-n_tokens // 4)
    ranks = decode_ranks(content[at : at + n_control], content[at + n_control :], n_tokens)
    return doc_ids, lengths, ranked[ranks] if n_tokens else np.zeros(0, "<u4")


def shard_bounds(docs: DataFrame, shard_text_bytes: int, id_column: str = "doc_id", text_column: str = "text") -> list[int]:
    """doc_ids at which shards of about equal numbers of rows begin, so many that their texts average shard_text_bytes at most, and that every task of a shuffle has one of 1 MB at least; MOST_SHARDS at most."""
    total = int(docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0)
    n = min(MOST_SHARDS, max(-(-total // shard_text_bytes), min(total >> 20, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    if n < 2:
        return []
    cuts = docs.agg(F.percentile_approx(id_column, [i / n for i in range(1, n)], min(1_000_000, 50 * n))).first()[0]
    return sorted(set(cuts or []))


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_text_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts, append end_id to each and write token files in ascending id order under path.

    Returns the manifest: path, shard, part, n_docs, n_tokens; shard and part give the files' order. Texts are
    encoded once where they lie; only packed ids move, once, to the shard of their doc_id. Files hold about
    shard_text_bytes of text; a shard with more (repeated ids, long texts, over MOST_SHARDS files) is cut into
    further parts, so a task's memory stays bounded.

    Null text: only end_id. Null ids come first. Repeated ids: each row is a document of its own, ordered by
    its ids' bytes. Empty table: no file. Other columns are ignored.
    """
    bounds = np.array(shard_bounds(docs, shard_text_bytes, id_column, text_column), dtype=np.int64)
    most = 2 * shard_text_bytes

    def encode(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        to_ids, packer = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end, width = np.array([end_id], to_ids.dtype).tobytes(), np.dtype(to_ids.dtype).itemsize
        copies = common.once_per_process(f"texts {tokenizer} {end_id}", lambda: [{}, {}])

        def packed(text: bytes | None) -> bytes:
            key = hashlib.sha256(text or b"").digest()
            out = copies[0].get(key) or copies[1].get(key)
            if out is None:
                out = packer.compress(to_ids(text.decode() if text else None) + end)
                if len(out) <= 1 << 14:
                    if len(copies[0]) >= KEPT_TEXTS:
                        copies[:] = [{}, copies[0]]
                    copies[0][key] = out
            return out

        for batch in common.slices(batches, 500):
            doc_ids, texts = batch.column(0).to_pylist(), common.text_bytes(batch.column(1))
            shard = np.searchsorted(bounds, [0 if d is None else d for d in doc_ids], side="right").astype(np.int32)
            if None in doc_ids:
                shard[[k for k, d in enumerate(doc_ids) if d is None]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(doc_ids, pa.int64()), pa.array([width] * len(doc_ids), pa.int32()), pa.array(map(packed, texts), pa.binary())], names=["shard", "doc_id", "width", "packed"])

    def write(batches):
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        made: list[tuple] = []
        doc_ids, ids, size, now, part, width = [], [], 0, None, 0, 4

        def flush():
            nonlocal doc_ids, ids, size, part
            if doc_ids:
                name = f"{path}/shard-{now:08d}-{part:05d}.tids"
                common.write_file(name, [shard_bytes(doc_ids, ids, f"<u{width}")])
                made.append((name, now, part, len(doc_ids), size // width))
                doc_ids, ids, size, part = [], [], 0, part + 1

        for batch in batches:
            for shard, doc_id, width, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    flush()
                    now, part = shard, 0
                raw = unpacker.decompress(packed)
                if size + len(raw) > most:
                    flush()
                doc_ids.append(doc_id)
                ids.append(raw)
                size += len(raw)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "shard", "part", "n_docs", "n_tokens"])

    ids = docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(encode, "shard int, doc_id long, width int, packed binary")
    n = len(bounds) + 1
    placed = ids.repartition(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "packed")
    return common.written(placed.mapInArrow(write, "path string, shard int, part int, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, batch_tokens: int = 1 << 20) -> DataFrame:
    """Documents behind a manifest: doc_id, start (ids in all documents before it), n_tokens, ids (u32 bytes).

    The running sum that gives each file its start goes over shards, at most MOST_SHARDS rows, then over the parts
    of each shard; documents' own starts follow inside each file. Null and repeated doc_ids come back as they were
    written. An empty manifest gives no row.
    """
    from pyspark.sql import Window

    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", before(Window.orderBy("shard"), "n").alias("base"))
    files = manifest.withColumn("inside", before(Window.partitionBy("shard").orderBy("part"), "n_tokens")).join(shards, "shard")
    files = files.select("path", (F.col("base") + F.col("inside")).alias("first"), "shard")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, at = common.filesystem(path)
                with files.open_input_stream(at) as f:
                    doc_ids, lengths, ids = read_shard(f.read())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                lo = 0
                while lo < len(doc_ids):
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + batch_tokens, side="right")))
                    # Documents lie one behind another: their ids are one buffer, cut by offsets.
                    cuts = ((np.append(starts[lo:hi], ends[hi - 1]) - starts[lo]) * 4).astype(np.int32)
                    raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(ids[starts[lo] : ends[hi - 1]], "<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi] + first), pa.array(lengths[lo:hi]), raw], names=["doc_id", "start", "n_tokens", "ids"])
                    lo = hi

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "shard").select("path", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")

"""Packing documents into sequences of bounded length by attention cost."""

from __future__ import annotations

import heapq

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


def piece_cost(length: int, linear: float, quadratic: float) -> float:
    """Cost of a piece: its tokens pass through every layer, and attend to each other."""
    return linear * length + quadratic * length * length


def pack_block(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths; returns (document, start, length, sequence, offset), sequences from 0.

    Whole runs of capacity fill sequences of their own. What is left of each document goes, longest first, to
    the sequence of lowest cost that has room; a piece longer than that room is cut there and its rest goes
    on to the next. As many sequences are open as the rest needs, less the last part of one, so all but one
    end full; that one holds the remainder.
    """
    pieces, n = [], 0
    rest = []
    for k, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((k, start, capacity, n, 0))
            n += 1
        if length % capacity:
            rest.append((length % capacity, k, length - length % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    opened = -(-total // capacity)
    room = [capacity] * opened
    if total % capacity:
        room[-1] = total % capacity
    heap = [(0.0, s) for s in range(opened)]
    for length, k, start in rest:
        while length:
            cost, s = heapq.heappop(heap)
            part = min(length, room[s])
            pieces.append((k, start, part, n + s, (capacity if s < opened - 1 or not total % capacity else total % capacity) - room[s]))
            room[s] -= part
            start, length = start + part, length - part
            if room[s]:
                heapq.heappush(heap, (cost + piece_cost(part, linear, quadratic), s))
    return pieces


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, block_tokens: int = 4 << 20, kept: int = 400_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack every document (its ids, then end_id) into sequences of at most capacity ids.

    One row for each piece: doc_id, start, length, ids (u32 bytes), doc_tokens, sequence_id, offset. Each task
    packs blocks of about block_tokens as they lie, so nothing is shuffled and a worker holds one
    block (and what the encoder keeps, see there); a block pads one sequence at most, under 1/4000 of its ids. sequence_id is the task's partition in the high
    bits and a running number in the low; an unchanged input gives the same result again.

    Null or empty text: one piece with end_id alone. Null or repeated ids: each row is a document of its own.
    Empty table: no row. Other columns are ignored. A text longer than a block makes a block of its own.
    """
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        to_ids = tokens.encoder(tokenizer, kept)
        end = np.array([end_id], to_ids.dtype).tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal base, doc_ids, ids, held
            lengths = [len(x) // 4 for x in ids]
            pieces = pack_block(lengths, capacity, linear, quadratic)
            for lo in range(0, len(pieces), 4096):
                k, start, length, sequence, offset = zip(*pieces[lo : lo + 4096], strict=True)
                raw = [ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(k, start, length, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_ids[d] for d in k], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()),
                    pa.array([lengths[d] for d in k], pa.int64()), pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
                ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += 1 + max((p[3] for p in pieces), default=-1)
            doc_ids, ids, held = [], [], 0

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(to_ids(text.as_py()) + end, to_ids.dtype).astype("<u4").tobytes()
                doc_ids.append(doc_id)
                ids.append(raw)
                held += len(raw) // 4
                if held >= block_tokens:
                    yield from flush()
        yield from flush()
        common.trim()

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

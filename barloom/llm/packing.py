"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's tokens end with id 0. Whole windows are cut off its front; they fill a sequence each.
The rests, one piece for each document, are packed in blocks of BLOCK pieces: every piece begins as a
partial partition of k windows, and the two partitions with the largest spread are merged, the fullest
window of one on the emptiest of the other, until one is left. k begins at the least number that could
hold the tokens and rises whenever a window exceeds the capacity. A block reads the rows of one
partition in order, so packing shuffles nothing and no key can be hot.

Edge cases: a null or empty text is the single token 0; null ids and repeated rows are packed like any
other; an empty table gives no rows; other columns are ignored; long texts are tokenised in leaves.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import little_endian, tokenized
from barloom.llm.common import documents, landed, mapped

CAPACITY = 1024
BLOCK = 256
END = 0


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by largest differencing of partitions into `windows` windows."""
    heap = []
    for i, s in enumerate(sizes):
        loads = np.zeros(windows, dtype=np.int64)
        loads[0] = s  # loads fall from left to right
        heap.append((-int(s), i, loads, np.array([i]), np.array([0])))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, items_a, at_a = heapq.heappop(heap)
        _, _, b, items_b, at_b = heapq.heappop(heap)
        loads = a + b[::-1]
        order = np.argsort(-loads, kind="stable")
        place = np.empty(windows, dtype=np.int64)
        place[order] = np.arange(windows)
        loads = loads[order]
        items = np.concatenate([items_a, items_b])
        at = place[np.concatenate([at_a, windows - 1 - at_b])]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), tie, loads - loads[-1], items, at))
        tie += 1
    out = np.zeros(len(sizes), dtype=np.int64)
    if heap:
        out[heap[0][3]] = heap[0][4]
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; no window holds more than `capacity`."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        if np.bincount(at, weights=sizes, minlength=windows).max(initial=0) <= capacity:
            return at
        windows += max(1, windows // 100)


def _pieces(capacity: int, tokens: bool):
    def finish(c, row, doc, ids):
        stored, n = little_endian(ids) + little_endian([END]), len(ids) + 1
        doc = None if doc is None or doc != doc else int(doc)
        out = []
        for at in range(0, n, capacity):
            piece = stored[4 * at : 4 * (at + capacity)]
            out.append({
                "doc_id": doc, "start": at, "length": len(piece) // 4, "ids_crc32": zlib.crc32(piece), "doc_tokens": n,
            } | ({"ids": piece} if tokens else {}))
        return out

    return finish


def _packed(capacity: int, block: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        # Sequence numbers: the partition above, a count in it below; a retried task gives the same.
        first = TaskContext.get().partitionId() << 40
        count, held, n = 0, [], 0

        def finished(table):
            nonlocal count
            sizes = table["length"].to_numpy()
            at = pack(sizes, capacity)
            order = np.argsort(at, kind="stable")
            sizes, at = sizes[order], at[order]
            run = np.cumsum(sizes) - sizes
            begin = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], run, 0)) if len(at) else run
            # Numbers without gaps also where a window of the last k stays empty.
            dense = np.cumsum(np.r_[0, at[1:] != at[:-1]]) if len(at) else at
            out = table.take(pa.array(order)).append_column("sequence_id", pa.array(first + count + dense))
            out = out.append_column("offset", pa.array(run - begin))
            count += int(dense[-1]) + 1 if len(dense) else 0
            return out.to_batches()

        for batch in batches:
            whole = batch.column("length").to_numpy() == capacity
            if whole.any():
                t = pa.Table.from_batches([batch]).filter(pa.array(whole))
                ids = first + count + np.arange(t.num_rows)
                count += t.num_rows
                t = t.append_column("sequence_id", pa.array(ids))
                yield from t.append_column("offset", pa.array(np.zeros(t.num_rows, np.int64))).combine_chunks().to_batches()
            rest = pa.Table.from_batches([batch]).filter(pa.array(~whole))
            held.append(rest)
            n += rest.num_rows
            while n >= block:
                table = pa.concat_tables(held).combine_chunks()
                yield from finished(table.slice(0, block).combine_chunks())
                held, n = [table.slice(block)], n - block
        if n:
            yield from finished(pa.concat_tables(held).combine_chunks())

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           block: int = BLOCK, path: str | None = None, tokens: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset),
    and `ids` (little-endian unsigned 32-bit) with tokens=True."""
    fields = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), "long")
    fields |= {"ids": "binary"} if tokens else {}
    pieces = landed(tokenized(docs, _pieces(capacity, tokens), fields, id_col, text_col, path))
    ddl = ", ".join(f"{c} {kind}" for c, kind in fields.items())
    return mapped(pieces, _packed(capacity, block), f"{ddl}, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    return packed(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}

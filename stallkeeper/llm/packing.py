"""Packing by multiway differencing: near-equal windows from pieces of documents."""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text
from .tokens import byte_bpe


def differencing(sizes: list[int], m: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp over ``m`` windows: (sum, items) of every window that got an item.

    A partial partition is its windows in ascending order of their sums, empty ones left out. The two with
    the largest spread are merged with opposing order: the fullest window of one meets the emptiest of the other.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - m
        if over > 0:  # the smallest of both meet, the others meet an empty window
            pairs = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[:over], b[over - 1 :: -1])]
            a = sorted(pairs + a[over:] + b[over:], key=lambda w: w[0])
        else:
            for w in b:
                insort(a, w, key=lambda x: x[0])
        spread = a[-1][0] - (a[0][0] if len(a) == m else 0)
        heapq.heappush(heap, (-spread, number, a))
        number += 1
    return heap[0][2] if heap else []


def near_equal_windows(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Differencing into as few windows as the tokens need; the count rises while a window is over capacity."""
    m = math.ceil(sum(sizes) / capacity)
    while sizes:
        windows = differencing(sizes, m)
        if windows[-1][0] <= capacity:
            return windows
        m += max(1, m // 400)
    return []


def cut(n: int, capacity: int, max_piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full windows, and of the near-equal pieces of what is left."""
    full = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at, left = len(full) * capacity, n % capacity
    count = math.ceil(left / max_piece)
    ends = [at + left * (k + 1) // count for k in range(count)]
    return full, [(s, e - s) for s, e in zip([at, *ends], ends)]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         capacity: int = 2048, max_piece: int = 512, block_windows: int = 256) -> DataFrame:
    """Pieces of all documents, packed into windows of at most ``capacity`` tokens.

    A document's ids are the tokenizer's, then ``end_id``. Full windows are cut off first; the rest is cut into
    pieces of at most ``max_piece`` ids. Each task packs its own documents in blocks of ``block_windows`` windows,
    so nothing is shuffled and memory is one block, however the rows are dealt.

    Returns per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A null or empty text is the single id ``end_id``. Repeated rows are packed as often as they come; null ids stay null.
    An empty table gives no rows. Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        items: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held, kind = 0, None

        def flush() -> None:
            nonlocal sequence, items, held
            for _, members in near_equal_windows([len(x[2]) // 4 for x in items], capacity):
                offset = 0
                for i in sorted(members):
                    key, start, ids, n = items[i]
                    out.append((key, start, len(ids) // 4, ids, n, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            items, held = [], 0

        def batch() -> pa.RecordBatch:
            done = [pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(done, schema.names)

        for rows_in in batches:
            kind = rows_in.schema.field(0).type
            for at in range(0, rows_in.num_rows, 256):
                part = rows_in.slice(at, 256)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    full, rest = cut(n, capacity, max_piece)
                    for s, k in full:
                        out.append((key, s, k, ids[4 * s : 4 * (s + k)], n, sequence, 0))
                        sequence += 1
                    for s, k in rest:
                        items.append((key, s, ids[4 * s : 4 * (s + k)], n))
                        held += k
                    if held >= block_windows * capacity:
                        flush()
                    if len(out) >= 1000:
                        yield batch()
        flush()
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)

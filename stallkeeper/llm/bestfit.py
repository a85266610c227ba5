"""Packed id matrices: best-fit-decreasing with a segment tree over free capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_and_text, new_folder
from .tokens import byte_bpe


class FreeSpace:
    """Segment tree over the free capacities 0..n: how many open windows have each, and the smallest one that fits."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, window) of a window with the least free capacity >= need, taken out of the tree."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the nearest right neighbour that holds any
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return free, self.windows[free].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in descending size, each into the window it fills best, else a new one."""
    windows: list[list[int]] = []
    space = FreeSpace(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = space.take(sizes[i])
        if found is None:
            free, w = capacity, len(windows)
            windows.append([])
        else:
            free, w = found
        windows[w].append(i)
        space.add(free - sizes[i], w)
    return windows


def id_matrices(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                pad_id: int = 0, capacity: int = 2048, block_windows: int = 512, id_bytes: int = 2) -> DataFrame:
    """Rows of packed id matrices, one for each window of ``capacity`` ids.

    A document is the tokenizer's ids, then ``end_id``; one longer than a window is cut at every ``capacity`` ids, so
    nothing is lost. Each task packs its documents in blocks of about ``block_windows`` windows. Returns
    matrix_row (unique), n_tokens, ids (binary, capacity little-endian unsigned ids of ``id_bytes`` bytes, padded with
    ``pad_id``), cu_seqlens (0 and the end of each segment), position_resets (where position ids start at 0 again),
    doc_ids (of the type of the ids that come in) and doc_starts of the segments. A null text is the empty one (its end id only); an empty
    table gives no rows; null ids are kept; repeated rows are packed as often as they come; texts are packed whole, however long; other columns are
    not read. A vocabulary with ids that don't fit ``id_bytes`` is refused.
    """
    rows = id_and_text(docs, id_col, text_col)
    most = max(byte_bpe(tokenizer).library.get_vocab(True).values(), default=0)
    if max(most, end_id, pad_id) >> 8 * id_bytes:
        raise ValueError(f"ids up to {max(most, end_id, pad_id)} don't fit {id_bytes} bytes")
    key = rows.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("matrix_row long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>")
    schema = schema.add("doc_ids", T.ArrayType(key)).add("doc_starts", T.ArrayType(T.LongType()))
    unit = f"<u{id_bytes}"
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(to_arrow_type(key)), pa.list_(pa.int64()))
    names = ["matrix_row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, pieces, held = byte_bpe(tokenizer), TaskContext.get().partitionId() << 33, [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal row, pieces, held
            out = []
            for members in best_fit([len(p[2]) for p in pieces], capacity):
                matrix, cu = np.full(capacity, pad_id, unit), [0]
                for i in members:
                    matrix[cu[-1] : cu[-1] + len(pieces[i][2])] = pieces[i][2]
                    cu.append(cu[-1] + len(pieces[i][2]))
                out.append((row, cu[-1], matrix.tobytes(), cu, cu[:-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
                row += 1
            pieces, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids = np.frombuffer(raw + end, "<u4").astype(unit)
                    for s in range(0, len(ids), capacity):
                        pieces.append((key, s, ids[s : s + capacity]))
                    held += len(ids)
                    if held >= block_windows * capacity:
                        yield flush()
        if pieces:
            yield flush()

    return rows.mapInArrow(run, schema)


def write_matrices(matrices: DataFrame, path: str | None = None) -> DataFrame:
    """Write the matrix rows as Parquet under ``path`` (the shared folder by default) and read them back."""
    path = path or new_folder(matrices.sparkSession, "id-matrices")
    matrices.write.option("compression", "zstd").parquet(path)
    return matrices.sparkSession.read.schema(matrices.schema).parquet(path)

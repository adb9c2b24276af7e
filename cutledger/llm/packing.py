"""Bounded-space online packing of documents into fixed-size training sequences.

Every task keeps a fixed number of open windows. A document's ids are cut at whole windows; the rest is
placed best-fit, into the open window it leaves least room in. When none fits, the fullest window is
topped up with the head of the piece, which fills it exactly, and emitted. At the end of the task the
open windows are merged the same way, so at most one partly filled window is left for each task, and
those leftovers of many tasks are merged in a last step without cutting.

Defined cases: null text counts as empty, a document of its end id alone; every row is one document, so
repeated rows are packed again; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm

WINDOW, OPEN_WINDOWS = 4096, 32
#: Leftovers of so many tasks are merged by one.
MERGED_TASKS = 256
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = pa.schema([(c, pa.int64()) for c in COLUMNS] + [("task", pa.int64()), ("whole", pa.bool_())])
DDL = ", ".join(f"{c} long" for c in COLUMNS) + ", task long, whole boolean"


class Packer:
    """Open windows of one task; a piece is ``(doc_id, start, length, doc_tokens, ids)``."""

    def __init__(self, window: int, n_open: int):
        self.window, self.n_open = window, n_open
        self.open: list[list] = []  # [tokens held, pieces]
        self.done: list[list] = []

    def add(self, piece: tuple) -> None:
        key, start, length, total, ids = piece
        while length >= self.window:
            self.done.append([self.window, [(key, start, self.window, total, ids[: 4 * self.window])]])
            start, length, ids = start + self.window, length - self.window, ids[4 * self.window :]
        if not length:
            return
        piece = (key, start, length, total, ids)
        best = max((w for w in self.open if w[0] + length <= self.window), key=lambda w: w[0], default=None)
        if best is None and len(self.open) < self.n_open:
            self.open.append([length, [piece]])
        elif best is None:
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            self.open.append(self.top_up(fullest, piece))
        else:
            best[0] += length
            best[1].append(piece)
            if best[0] == self.window:
                self.open.remove(best)
                self.done.append(best)

    def top_up(self, full: list, piece: tuple) -> list:
        """Fill ``full`` with the head of ``piece`` and emit it; the tail opens a window."""
        key, start, length, total, ids = piece
        head = self.window - full[0]
        full[1].append((key, start, head, total, ids[: 4 * head]))
        full[0] = self.window
        self.done.append(full)
        return [length - head, [(key, start + head, length - head, total, ids[4 * head :])]]

    def merge(self) -> list | None:
        """Merge the open windows, cutting pieces; returns the one partly filled window that is left."""
        last: list | None = None
        for held, pieces in sorted(self.open, key=lambda w: -w[0]):
            if last is None:
                last = [held, pieces]
                continue
            for p in pieces:
                if last[0] + p[2] < self.window:
                    last[0] += p[2]
                    last[1].append(p)
                elif last[0] + p[2] == self.window:
                    last[1].append(p)
                    self.done.append([self.window, last[1]])
                    last = [0, []]
                else:
                    last = self.top_up(last, p)
        self.open = []
        return last if last and last[0] else None


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, n_open: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents with their sequence and offset; sequences but the last merged ones are full."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packer, number = Packer(window, n_open), 0
        ids_of, end = cm.word_encoder(tokenizer, cm.WORD), np.array([end_id], "<u4").tobytes()

        def rows(windows: list[list], whole: bool) -> pa.RecordBatch:
            nonlocal number
            cols: dict[str, list] = {f.name: [] for f in PIECES}
            for _, pieces in windows:
                offset = 0
                for key, start, length, total, ids in pieces:
                    for name, v in zip(PIECES.names, (key, start, length, zlib.crc32(ids), total, (task << 32) + number, offset, task, whole), strict=True):
                        cols[name].append(v)
                    offset += length
                number += 1
            return cm.batch(PIECES, cols)

        for got in batches:
            for key, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end
                packer.add((key, 0, len(ids) // 4, len(ids) // 4, ids))
            yield rows(packer.done, True)
            packer.done = []
        last = packer.merge()
        yield rows(packer.done, True)
        if last:
            yield rows([last], False)

    def join_leftovers(left: pa.Table) -> pa.Table:
        rows = left.sort_by([("task", "ascending"), ("offset", "ascending")]).to_pylist()
        windows: list[list] = []
        base = (1 << 62) + ((rows[0]["task"] // MERGED_TASKS) << 32)
        for r in sorted(rows, key=lambda r: -r["length"]):
            best = max((w for w in windows if w[0] + r["length"] <= window), key=lambda w: w[0], default=None)
            if best is None:
                windows.append(best := [0, base + len(windows)])
            r["offset"], r["sequence_id"] = best
            best[0] += r["length"]
        return pa.Table.from_pylist(rows, schema=left.schema)

    placed = cm.saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(place, DDL))
    left = placed.where(~F.col("whole")).withColumn("g", F.floor(F.col("task") / MERGED_TASKS))
    merged = left.groupBy("g").applyInArrow(lambda t: join_leftovers(t.drop_columns("g")), DDL)
    return placed.where("whole").unionByName(merged).select(*COLUMNS)

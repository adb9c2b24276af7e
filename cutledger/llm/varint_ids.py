"""Token-id files: frequency-ranked ids, byte-aligned lengths, control bytes kept apart.

A block holds whole documents. Its ids are replaced by their rank in the block's own frequency
table (most frequent first, ties by id), so common ids take one byte; a rank takes 1 to 4 bytes, and
the four lengths of four ranks share one control byte stored in a separate run. Decoding gathers the
bytes of all ranks at once: control bytes index a table of lengths, a running sum gives offsets.

Defined cases: null text counts as empty and keeps its end id; null ``doc_id`` sorts first; rows with
equal ``doc_id`` are ordered by text; an empty table gives no blocks and no rows; other input columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cutledger.llm import common as cm

BLOCK_IDS = 4_000_000
#: Ids below this are counted by number.
DENSE = 1 << 22
#: Lengths of the four ranks behind each control byte: two bits each, lowest first, one more than the bits say.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("table", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
BLOCK_DDL = (
    "part int, block int, n_ids long, doc_ids array<long>, n_tokens array<long>, table binary, control binary, data binary")


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``(table, control, data)`` of an id array."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and ids.max() < DENSE:  # the ids of a vocabulary: counted and looked up by number, without a sort
        counts = np.bincount(ids)
        known, at = np.flatnonzero(counts), ids
        counts = counts[known]
    else:
        known, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((known, -counts))
    rank_of = np.empty(int(known[-1]) + 1 if at is ids and len(known) else len(known), dtype=np.uint32)
    rank_of[known[order] if at is ids else order] = np.arange(len(known), dtype=np.uint32)
    ranks = rank_of[at]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    padded[: len(ids)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    split = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = split[np.arange(4, dtype=np.uint8) < size[:, None]]
    return known[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ids(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids that ``pack_ids`` was given."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.zeros(n, dtype=np.int64)
    np.cumsum(size[:-1], out=starts[1:]) if n > 1 else None
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = np.zeros(n, dtype=np.uint32)
    for k in range(int(size.max()) if n else 0):
        more = size > k
        ranks[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[ranks]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Tokenize ``(doc_id, text)`` and write its blocks to ``path`` in ascending ``doc_id`` order."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 64))  # in the order of the sort, so rows of one doc_id may spread
        .sortWithinPartitions("doc_id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of, end = TaskContext.get().partitionId(), cm.word_encoder(tokenizer, cm.SPACED_WORD), np.array([end_id], "<u4").tobytes()
        keys, runs, held, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            table, control, data = pack_ids(np.frombuffer(b"".join(runs), "<u4"))
            row = {"part": part, "block": number, "n_ids": held, "doc_ids": keys, "n_tokens": [len(r) // 4 for r in runs],
                   "table": table, "control": control, "data": data}
            return cm.batch(BLOCK, {k: [v] for k, v in row.items()})

        for got in batches:
            for key, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                run = ids_of(text) + end
                if held and held + len(run) // 4 > block_ids:
                    yield block()
                    keys, runs, held, number = [], [], 0, number + 1
                keys.append(key)
                runs.append(run)
                held += len(run) // 4
        if runs:
            yield block()

    ordered.mapInArrow(encode, BLOCK_DDL).write.parquet(path, compression="none")


def read_documents(blocks: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from blocks; ``start`` counts the ids of all earlier documents."""
    out = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for row in (got.slice(i, 1).to_pylist()[0] for i in range(got.num_rows)):
                ids = unpack_ids(row["table"], row["control"], row["data"], row["n_ids"]).tobytes()
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                n = len(ends)
                yield cm.batch(out, {
                    "part": [row["part"]] * n, "block": [row["block"]] * n, "doc_id": row["doc_ids"], "inside": starts,
                    "n_tokens": row["n_tokens"], "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]})

    # One row for each written block, then one for each writing task: neither grows with a group.
    blocks_before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = blocks.select("part", "block", blocks_before.alias("b")).join(parts.select("part", "before"), "part")
    docs = blocks.mapInArrow(decode, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("b") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` and return what is read back from them."""
    spark = docs.sparkSession
    path = path or cm.scratch_table(spark, "token-files")
    write_blocks(docs, path, tokenizer, end_id)
    return read_documents(spark.read.schema(BLOCK_DDL).parquet(path))

"""Phrase collocations mined by dynamic itemset counting.

Texts are cut once into blocks of word numbers, dealt over ``SHARDS`` shards. Shards are scanned in turn, again
and again, and phrases of all lengths are counted side by side: words from the first shard on, a longer phrase from
the scan on after which both phrases inside it (without its last word, without its first) had reached the threshold. Each
phrase stops after one full cycle, so its count is exact; the mining ends when no phrase is open.

A scan must know since when a phrase is active without a copy of all phrases: three tables of fixed size (``SLOTS``
entries for each length) hold, for the hash of a phrase, the first scan at which a phrase of that slot was frequent. The
start of a phrase is the later of its two parts' entries; two phrases in one slot only make some be counted that need not
be, from a start all scans agree on. Counts are kept by the phrase itself, in tables in the shared folder; phrases that have ended below
the threshold are dropped from them, as no result needs them.

Defined cases: null text counts as empty, null language as ``und``; an empty table, or one without a frequent phrase,
gives no rows; repeated rows count each time; a text longer than a block is cut between words, and the phrases across the
cut belong to the second block; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cutledger.llm import common as cm, hashing

SHARDS, LONGEST, LEAST, TOP = 4, 4, 30, 2000
SLOTS, NEVER = 1 << 22, 255
#: Words of a block at least, if its task has as many, and bytes of a text that are cut into words at once.
BLOCK_WORDS, SEGMENT = 500_000, 1 << 20
UNKNOWN = "und"
#: Lower-cases A-Z; makes every mark between pieces a line feed, and the tab a blank.
LETTERS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK_DDL = "shard int, lang string, n_words long, lead int, words binary, ids binary"
COUNT_DDL = "k int, start int, h long, n long"


class Vocabulary(dict):
    """Word to number, new words numbered from 1 as they come; 0 stands between pieces, -1 for nothing."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def word_numbers(data: bytes, known: Vocabulary) -> np.ndarray:
    """Numbers of the words of translated bytes."""
    ids = np.array([known[w] for w in data.replace(b"\n", b" \n ").split(b" ")], np.int32)
    return ids[ids >= 0]


def pieces(data: bytes) -> Iterator[bytes]:
    """Translated bytes in parts of about ``SEGMENT`` bytes, cut between words."""
    at = 0
    while at < len(data):
        cut = min((p for p in (data.find(b" ", at + SEGMENT), data.find(b"\n", at + SEGMENT)) if p >= 0), default=len(data))
        yield data[at:cut]
        at = cut


class Builder:
    """Blocks of one language; a block that starts inside a piece repeats the last words before it as its ``lead``."""

    def __init__(self, lang: str):
        self.lang, self.last = lang, []
        self.clear()

    def clear(self) -> None:
        self.known, self.runs, self.held, self.lead = Vocabulary({b"": -1, b"\n": 0}), [], 0, 0

    def add(self, data: bytes) -> None:
        ids = word_numbers(data, self.known)
        self.runs.append(ids)
        self.held += len(ids)

    def block(self, shard: int) -> dict:
        ids = np.concatenate(self.runs)
        words = list(self.known)[2:]
        tail = ids[-(LONGEST - 1):]
        breaks = np.flatnonzero(tail == 0)
        last = [words[i - 1] for i in (tail[breaks[-1] + 1 :] if len(breaks) else tail)]
        row = {"shard": shard, "lang": self.lang, "n_words": int((ids[self.lead :] > 0).sum()), "lead": self.lead, "words": b"\n".join(words), "ids": ids.tobytes()}
        self.clear()
        if last:
            self.add(b" ".join(last))
            self.lead = self.held
        return row


def write_blocks(docs: DataFrame, path: str, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> None:
    """Write the blocks of ``docs`` by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n_words", pa.int64()), ("lead", pa.int32()), ("words", pa.binary()), ("ids", pa.binary())])
        number, builders = TaskContext.get().partitionId(), {}

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for b in builders.values():
                if b.held - b.lead >= least:
                    number += 1
                    yield cm.batch(schema, {k: [v] for k, v in b.block(number % shards).items()})

        for got in batches:
            for lang, text in zip(*(c.to_pylist() for c in got.columns), strict=True):
                own = builders.setdefault(lang, Builder(lang))
                for part in pieces(text.encode("utf-8", "surrogatepass").translate(LETTERS)):
                    own.add(part)
                    yield from full(block_words)
                own.add(b"\n")
                if sum(b.held for b in builders.values()) >= 4 * block_words:
                    yield from full(1)
                    builders.clear()
        yield from full(1)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(run, BLOCK_DDL).write.option("parquet.block.size", 16 << 20).partitionBy("shard").parquet(path)


def active(start: np.ndarray, scan: int, shards: int) -> np.ndarray:
    return (start <= scan) & (start > scan - shards)


def hashed(lang: str, words: list[str], ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the hash of the phrase that starts at a place, and whether one does; words of different languages differ."""
    seed = xxhash.xxh64_intdigest(lang)
    named, begin = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)[ids], ids > 0
    part, live = named, begin
    yield part, begin
    for k in range(2, longest + 1):
        part, begin = hashing.pair(part[:-1], named[k - 1 :]), begin[:-1] & live[k - 1 :]
        yield part, begin


def slots_of(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(h & np.uint64(len(table) - 1)).astype(np.int64)]


def count_block(lang: str, words: list[str], ids: np.ndarray, lead: int, scan: int, shards: int, since: list[np.ndarray], lengths: list[int]) -> Iterator[tuple]:
    """``(k, start, h, n)`` arrays of the phrases of a block that are active in this scan."""
    shorter = None
    for k, (part, begin) in enumerate(hashed(lang, words, ids, max(lengths)), 1):
        if k in lengths:
            slots = np.zeros(len(part) + 1, np.uint8) if shorter is None else slots_of(shorter, since[k - 2])
            start = np.maximum(slots[:-1], slots[1:])
            keep = begin & active(start, scan, shards)
            keep[: max(0, lead - k + 1)] = False
            h, first, n = np.unique(part[keep], return_index=True, return_counts=True)
            yield k, start[keep][first], h, n
        shorter = part


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for got in batches:
        for lang, lead, words, ids in zip(*(c.to_pylist() for c in got.columns), strict=True):
            yield lang, lead, words.decode().split("\n"), np.frombuffer(ids, np.int32)


def counted(blocks: DataFrame, scan: int, shards: int, shared: Broadcast, lengths: list[int]) -> DataFrame:
    """``COUNT_DDL`` rows of the active phrases of a shard, added up by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = [np.frombuffer(zlib.decompress(z), np.uint8) for z in shared.value]
        for lang, lead, words, ids in each_block(batches):
            for k, start, h, n in count_block(lang, words, ids, lead, scan, shards, since, lengths):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(h), k, np.int32)), pa.array(start.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "start", "h", "n"])

    return blocks.select("lang", "lead", "words", "ids").mapInArrow(run, COUNT_DDL)


def spelled(blocks: DataFrame, shared: Broadcast, longest: int) -> DataFrame:
    """``(lang, k, h, phrase)`` of the phrases whose slot holds a frequent one, once for each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [np.unpackbits(np.frombuffer(zlib.decompress(z), np.uint8), bitorder="little").astype(bool) for z in shared.value]
        for lang, _, words, ids in each_block(batches):
            texts = np.array(["", *words], object)
            for k, (part, begin) in enumerate(hashed(lang, words, ids, longest), 1):
                at = np.flatnonzero(begin & slots_of(part, wanted[k - 1]))
                h, first = np.unique(part[at], return_index=True)
                text = texts[ids[at[first]]]
                for j in range(1, k):
                    text = text + " " + texts[ids[at[first] + j]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(text, pa.string())], names=["lang", "k", "h", "phrase"])

    return blocks.select("lang", "lead", "words", "ids").mapInArrow(run, "lang string, k int, h long, phrase string")


def frequent_slots(counts: DataFrame, least: int, longest: int, slots: int) -> np.ndarray:
    """Bytes of a bit for each slot of each length: whether it holds a frequent phrase. At most ``slots / 64`` rows a length are collected."""
    slot = F.col("h").bitwiseAND(F.lit(slots - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    held = counts.where((F.col("n") >= least) & (F.col("k") <= longest)).groupBy("k", F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros((longest, slots // 64), np.int64)
    for r in held.collect():
        bits[r["k"] - 1, r["word"]] = r["bits"]
    return bits.view(np.uint8)


def frequent(spark: SparkSession, blocks: str, shards: int = SHARDS, least: int = LEAST, longest: int = LONGEST, slots: int = SLOTS) -> DataFrame:
    """``(lang, k, phrase, n)``: all phrases that occur ``least`` times or more, with their exact counts."""
    if longest * shards >= NEVER:
        raise ValueError("a scan's number must stay below 255")
    source = spark.read.schema(BLOCK_DDL).parquet(blocks)
    since = [np.full(slots, NEVER, np.uint8) for _ in range(longest - 1)]
    opened: list[set[int]] = [{0}] + [set() for _ in range(longest - 1)]  # scans at which phrases of a length may start
    table, scan = None, 0
    while lengths := [k + 1 for k, starts in enumerate(opened) if any(s <= scan < s + shards for s in starts)]:
        shared = spark.sparkContext.broadcast([zlib.compress(x.tobytes(), 1) for x in since])
        raw = counted(source.where(F.col("shard") == scan % shards), scan, shards, shared, lengths)
        before = spark.read.parquet(table) if table else None
        summed = (raw if before is None else before.unionByName(raw)).groupBy("k", "start", "h").agg(F.sum("n").alias("n"))
        path = cm.scratch_table(spark, "collocations-counts")
        summed.where((F.col("n") >= least) | (F.col("start") + shards - 1 > scan)).write.parquet(path)
        shared.destroy()
        if table:
            cm.drop_table(spark, table)
        table, scan = path, scan + 1
        bits = frequent_slots(spark.read.parquet(table), least, longest - 1, slots)
        for k in range(longest - 1):
            new = np.unpackbits(bits[k], bitorder="little").astype(bool) & (since[k] == NEVER)
            if new.any():
                since[k][new] = scan
                opened[k + 1].add(scan)
    return named(spark, source, table, shards, least, longest, slots)


def named(spark: SparkSession, source: DataFrame, table: str, shards: int, least: int, longest: int, slots: int) -> DataFrame:
    """The phrases of the counts, spelled by one shard after the other: each is looked for only until a shard holds it."""
    path = cm.scratch_table(spark, "collocations-frequent")
    for shard in range(shards):
        counts = spark.read.parquet(table)
        bits = frequent_slots(counts, least, longest, slots)
        if shard and not bits.any():
            break
        shared = spark.sparkContext.broadcast([zlib.compress(x.tobytes(), 1) for x in bits])
        spelled(source.where(F.col("shard") == shard), shared, longest).distinct().join(counts, ["k", "h"]).select(
            "lang", "k", "h", "phrase", "n").write.mode("append").parquet(path)
        shared.destroy()
        if shard < shards - 1:
            rest = cm.scratch_table(spark, "collocations-unnamed")
            counts.select("k", "h", "n").join(spark.read.parquet(path).select("k", "h"), ["k", "h"], "left_anti").write.parquet(rest)
            cm.drop_table(spark, table)
            table = rest
    cm.drop_table(spark, table)
    return spark.read.parquet(path).drop("h")


def scored(found: DataFrame) -> DataFrame:
    """``(lang, phrase, k, a, l, r, score)`` of every phrase of two words or more, by its lowest-scoring cut."""
    whole = F.split("phrase", " ", -1)
    join = lambda at, n: F.array_join(F.slice(whole, at, n), " ")
    cuts = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def maximal(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates but those inside a longer one that has ``percent`` of their occurrences or more."""
    words = F.split("phrase", " ", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    inside = candidates.where("k > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda n, c: F.lit(n).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide(100, "longer") < wide(percent, "a"))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` collocations of each language."""
    spark = docs.sparkSession
    blocks = cm.scratch_table(spark, "collocations-blocks")
    write_blocks(docs, blocks, shards, block_words)
    words = cm.saved(spark.read.schema(BLOCK_DDL).parquet(blocks).groupBy("lang").agg(F.sum("n_words").alias("n")))
    found = frequent(spark, blocks, shards, least, slots=slots)
    cm.drop_table(spark, blocks)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked in 64 parts of a language first, so that the last ranking sees 64 * top rows of it at most.
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = maximal(scored(found)).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

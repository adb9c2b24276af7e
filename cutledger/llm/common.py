"""Pieces shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from cutledger.llm import hashing

#: Bytes of an Arrow batch that Spark sends to a Python worker, or one row.
BATCH_BYTES = 1 << 22
#: Rust's white space differs from Python's only by the four separators below, which Rust keeps.
WORD = re.compile(r"[\S\x1c-\x1f]+")
SPACED_WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Cached words between single spaces, and cached other pieces (first words of lines, irregular white space).
CACHE_WORDS, CACHE_PIECES = 700_000, 100_000


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = f"{tempfile.gettempdir()}/cutledger-checkpoints"
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table an operator writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that are dropped when the result that needed them has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back, cut off from its lineage."""
        self.paths.append(scratch_table(self.spark, self.name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, paths: list[str] | None = None) -> None:
        """Delete these tables, or all."""
        for path in list(self.paths if paths is None else paths):
            drop_table(self.spark, path)
            self.paths.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes as well as by rows, since texts differ in length; a setting of the session's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Give the free memory of this Python worker back to the system."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def forget_tables() -> None:
    """Drop the tokenizer tables of this process. Named in a task, the tables themselves would be sent along and a copy emptied."""
    _CACHES.clear()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task that leaves little behind, as its worker goes on to tasks of other operators.

    Tokenizer tables that an earlier operator left in the worker go before the task, free memory after it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        try:
            yield from run(batches)
        finally:
            released()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(counts: dict, bound: int) -> dict:
    """``bound`` dealt evenly over groups of these sizes; what a small group leaves goes to the larger ones."""
    out, left = {}, bound
    for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], str(g)))):
        out[g] = min(counts[g], max(1, left // (len(counts) - i)))
        left -= out[g]
    return out


def least_hashes(rows: DataFrame, bound: int) -> list:
    """Of ``(h, g, ...)`` rows, one for each ``h`` and group, every group's share of ``bound``: its rows of least ``h``.

    A bound on the hash, from the exact size of each group, leaves little more than the share, so no task sorts a group.
    """
    rows = saved(rows)
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    share = shares(sizes, bound)
    limit = lambda g: min(2**63 - 1, int((1.3 * share[g] + 50) / sizes[g] * 2**64) - 2**63)
    below = [F.col("g").eqNullSafe(F.lit(g)) & (F.col("h") <= F.lit(limit(g)).cast("long")) for g in share]
    if not below:
        return []
    near = below[0]
    for b in below[1:]:
        near = near | b
    out, taken = [], dict.fromkeys(share, 0)
    for r in sorted(rows.where(near).collect(), key=lambda r: (r["h"], str(r["g"]))):
        if taken[r["g"]] < share[r["g"]]:
            taken[r["g"]] += 1
            out.append(r)
    return out


def words(column) -> F.Column:
    """Lower-cased words of a text, split at ASCII white space; no words: an empty array."""
    low = F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


class WordIds:
    """Word to packed ids (unsigned 32-bit, little-endian); ``encode`` gives the ids of new words at once.

    A byte-pair tokenizer never merges across the boundaries its pattern sets, so a word's ids don't
    depend on the words around it. At ``room`` words the cache starts again, which bounds memory.
    """

    def __init__(self, encode, room: int):
        self.encode, self.room = encode, room
        self.known: dict[str, bytes] = {}

    def joined(self, words: list[str]) -> bytes:
        """Packed ids of ``words`` in a row."""
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) >= self.room:
                self.known.clear()
            new = set(words).difference(self.known)
            self.known.update(zip(new, self.encode(new), strict=True))
            found = map(self.known.__getitem__, words)
        return b"".join(found)


class Pieces:
    """Packed ids of whole texts from the ids of their words.

    Lines of words between single spaces, as most are, need no pattern: their words are cached bare.
    All other texts are cut by ``pattern``. In a spaced vocabulary
    a cached word carries the space before it.
    """

    def __init__(self, pattern: re.Pattern, encode):
        self.pattern, self.spaced = pattern, pattern is SPACED_WORD
        lead = " " if self.spaced else ""
        self.words = WordIds(lambda words: encode([lead + w for w in words]), CACHE_WORDS)
        self.others = WordIds(encode, CACHE_PIECES)

    def ids(self, text: str) -> bytes:
        if not self.spaced:
            plain = not any(map(text.__contains__, "\x1c\x1d\x1e\x1f"))
            return self.words.joined(text.split() if plain else self.pattern.findall(text))
        out, mark = [], ""
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:
                return self.others.joined(self.pattern.findall(text))
            out.append(self.others.joined([mark + words[0]]))
            out.append(self.words.joined(words[1:]))
            mark = "\n"
        return b"".join(out)


_CACHES: dict[tuple[str, str], tuple] = {}


def byte_letters() -> dict[int, str]:
    """Code point of a byte-level letter to the character of its byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {256 + i: chr(b) for i, b in enumerate(others)}


class BytePairs:
    """Merges of a byte-level vocabulary file for single pre-split pieces; the end-of-word mark is byte 255."""

    END = b"\xff"

    def __init__(self, spec: dict):
        import tiktoken

        model, letters = spec["model"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        raw = lambda t: (t.removesuffix(suffix).translate(letters).encode("latin-1") + self.END) if suffix and t.endswith(suffix) else t.translate(letters).encode("latin-1")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = {raw(t): vocab[t] for t in (chr(c) for c in letters)}
        if suffix:
            order |= {raw(chr(c) + suffix): vocab[chr(c) + suffix] for c in letters}
        order |= {raw(a + b if not suffix else a.removesuffix(suffix) + b): vocab[a + b] for a, b in pairs}
        self.ids = [i.to_bytes(4, "little") for i in order.values()]
        self.end = self.END if suffix else b""
        self.core = tiktoken.Encoding("pieces", pat_str="", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})._core_bpe

    def piece(self, piece: str) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in self.core.encode_single_piece(piece.encode() + self.end)])

    def pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.piece, pieces))


#: How each kind of vocabulary file cuts a word: lower-casing or not, a pattern, and the words it is exact for.
#: Patterns are fixed values of the files; other letters than these go through the tokenizers library.
CUTS = {
    SPACED_WORD.pattern: (False, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+", re.compile(" ?[\x21-\x7e\xa1-\u024f]+")),
    WORD.pattern: (True, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", re.compile("[\x21-\x7e\xa1-\u024f]+")),
}


def word_encoder(path: str, pattern: re.Pattern):
    """``text -> packed ids`` of a ``tokenizers`` file, one cache per Python worker and file.

    New words of Latin letters are merged by ``tiktoken``'s routine over the same merges, which is many
    times faster for single words; all others, and texts with special tokens, by ``tokenizers``.
    """
    key = (path, pattern.pattern)
    if key not in _CACHES:
        import json

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pairs = BytePairs(json.load(f))
        lower, cut, known = CUTS[pattern.pattern]
        cut = regex.compile(cut)

        def each(words: list[str] | set[str]) -> list[bytes]:
            made = []
            for w in words:
                if w.isascii() and w.removeprefix(" ").isalpha():  # one piece, as most words are
                    made.append(pairs.piece(w.lower() if lower else w))
                elif known.fullmatch(w):
                    made.append(pairs.pieces(cut.findall(w.lower() if lower else w)))
                else:
                    made.append(np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes())
            return made

        _CACHES[key] = (Pieces(pattern, each), [t.content for t in tokenizer.get_added_tokens_decoder().values()], tokenizer)
    cache, marks, tokenizer = _CACHES[key]

    def encode(text: str) -> bytes:
        if any(m in text for m in marks):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return cache.ids(text)

    return encode


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(texts: pa.Array, room: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``room`` bytes of text together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
        yield at, end
        at = end

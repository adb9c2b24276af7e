"""SentencePiece encoding with byte offsets into the original text, and decoding.

The compiled character map of a model is a double-array trie with replacement strings. Normalisation
takes, at each place, the longest prefix the trie knows and records for every byte it writes which
source byte it came from. Pieces tile the normalised text, so cutting that record at piece ends
projects every piece to a span of the original bytes.

Defined cases: null text counts as empty (end id only, empty decoded text, no pieces); rows are
independent, so repeated rows repeat; other input columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm

MARK = "▁".encode()


def fields_of(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a serialized message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = message[at : at + size]
            at += size
        yield key >> 3, value


class CharMap:
    """Longest-prefix lookup in a compiled map: 4 bytes trie size, trie units, zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = struct.unpack(f"<{size // 4}I", compiled[4 : 4 + size])
        self.texts = compiled[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """``(source bytes taken, replacement)`` of the longest known prefix at ``at``."""
        best, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(source)):
            node ^= source[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != source[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                text = self.units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[text : self.texts.index(b"\0", text)])
        return best

    def apply(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each, the source byte it came from (one more entry for the end)."""
        if not self.units:
            return source, np.arange(len(source) + 1)
        out, origin, at = bytearray(), [], 0
        while at < len(source):
            taken, text = self.longest(source, at) or (0, b"")
            if not taken:
                taken = 1
                while at + taken < len(source) and source[at + taken] & 0xC0 == 0x80:
                    taken += 1
                text = source[at : at + taken]
                origin += range(at, at + taken)
            else:
                origin += [at] * len(text)
            out += text
            at += taken
        return bytes(out), np.array([*origin, len(source)])


class OffsetEncoder:
    """Ids, piece spans and decoded text of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = f.read()
        spec = dict(fields_of(next((v for k, v in fields_of(proto) if k == 3), b"")))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.numbers = [str(i) for i in range(len(pieces))]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), "<u4")

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised text as the pieces spell it, with the source byte of each of its bytes."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        plain, origin = self.map.apply(source)
        if self.trim:
            raw = np.frombuffer(plain, np.uint8) == 32
            keep = ~raw | ~np.concatenate([[True], raw[:-1]])
            if len(keep) and raw[-1]:
                keep[np.flatnonzero(~raw)[-1] + 1 if (~raw).any() else 0 :] = False
            plain, origin = np.frombuffer(plain, np.uint8)[keep].tobytes(), np.concatenate([origin[:-1][keep], origin[-1:]])
        if self.prefix and plain:
            plain, origin = b" " + plain, np.concatenate([origin[:1], origin])
        if self.escape:
            wide = np.where(np.frombuffer(plain, np.uint8) == 32, len(MARK), 1)
            plain, origin = plain.replace(b" ", MARK), np.concatenate([np.repeat(origin[:-1], wide), origin[-1:]])
        return plain, origin

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in the original bytes."""
        normal, origin = self.normalise(text)
        size = self.lengths[ids]
        if int(size.sum()) != len(normal):  # unknown pieces spell what they stand for
            pieces = self.model.encode(text, return_type="proto").pieces
            size = np.array([len(p.surface.encode()) if p.id == self.model.unk_id() else self.lengths[p.id] for p in pieces], np.int64)
            if int(size.sum()) != len(normal):
                raise ValueError("pieces do not tile the normalised text")
        ends = np.cumsum(size)
        return origin[ends - size], origin[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_ENCODERS: dict[str, OffsetEncoder] = {}


def encoder(path: str) -> OffsetEncoder:
    """One encoder per Python worker and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = OffsetEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids``, ``starts``, ``ends`` (source bytes of each piece) and the decoded text."""
    schema = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", ids array<int>, starts array<int>, ends array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for got in batches:
            rows = []
            for text in got.column(got.num_columns - 1).to_pylist():
                ids = e.ids(text)
                starts, ends = e.spans(text, ids)
                rows.append((np.append(ids, e.model.eos_id()).astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), e.decode(ids)))
            kinds = [pa.list_(pa.int32())] * 3 + [pa.string()]
            made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*got.columns[:-1], *made], names=[*got.schema.names[:-1], "ids", "starts", "ends", "decoded"])

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, ddl)


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digests of ids and decoded text, crc32 of the piece spans."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        number = e.numbers.__getitem__
        for got in batches:
            rows = []
            for key, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                listed = e.model.encode(text, num_threads=1)
                ids = np.array(listed, "<u4")
                starts, ends = e.spans(text, ids)
                spelled = " ".join(map(number, [*listed, e.model.eos_id()])).encode()
                rows.append((key, len(listed) + 1, hashlib.sha256(spelled).hexdigest(), hashlib.sha256(e.model.decode(listed).encode()).hexdigest(),
                             zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(starts.astype("<i4").tobytes()))))
            yield cm.batch(out, {f.name: [r[k] for r in rows] for k, f in enumerate(out)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

"""Removal of long byte strings that occur more than once, by bucket refinement of suffixes.

A byte goes when a ``LENGTH``-byte string that covers it also starts somewhere else. Suffixes are bucketed
by the identifier of their first ``GRAM`` bytes; buckets are refined by pairing a suffix's identifier with
that of the suffix ``GRAM`` bytes later, then twice as far, and so on to ``LENGTH``; identifiers
found once serve all later steps, and a suffix alone in its bucket is dropped. Three things keep that cheap:

* Of all suffixes inside a window of ``LENGTH`` bytes only the one with the least initial identifier, the
  leftmost of equals, goes to a bucket first: equal windows choose the same suffix at the same place. Only
  windows whose chosen suffix is not alone are looked at further.
* Such windows are sent, as one stretch of bytes for each chosen suffix, to the task of its bucket and
  refined there by sorting.
* Buckets of more than ``HOT`` stretches are refined by counting instead, so no task holds one: a range of
  windows is dropped if the bytes common to all of them are unique, kept if their hull is repeated, and halved
  otherwise.

Equal texts are handled once, with the number of their copies. Identifiers have 64 bits. Defined cases: null
text counts as empty; texts shorter than ``LENGTH`` lose nothing; matches never cross rows; a repeated
row is another place, so both lose all their bytes if long enough; an empty table gives no rows;
columns not asked for are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm, hashing
from cutledger.llm.jaccard_join import keyed

LENGTH, GRAM = 400, 100
#: Bytes of the passages that are reported beside the repeats of ``LENGTH`` bytes, and of the identifiers they are found by.
PASSAGE, PASSAGE_GRAM = 150, 50
#: Stretches one task sorts together at most, some hundred bytes and windows each; and how many are taken at a time.
HOT, CHUNK = 16_384, 2048
SEGMENT = 1 << 22
PLACE = np.uint64((1 << 28) - 1)


def chosen(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start its chosen suffix, and the initial identifier of every suffix that is chosen there."""
    ids = hashing.grams(hashing.running(data), gram)
    key = (ids & ~PLACE) | np.arange(len(ids), dtype=np.uint64)
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    if wide < span:
        key = np.minimum(key[: len(key) - (span - wide)], key[span - wide :])
    place = (key & PLACE).astype(np.int64)
    return place, ids


def segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of a long text; every window lies in one."""
    for at in range(0, len(data) - length + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def as_bytes(text: str | bytes) -> np.ndarray:
    return np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), np.uint8)


def first_buckets(rows: DataFrame, length: int, gram: int, scratch: cm.Scratch) -> DataFrame:
    """``(anchor, th, times)``: buckets each distinct text puts its chosen suffixes in."""
    out = pa.schema([("anchor", pa.int64()), ("th", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # one entry for each distinct text of the task
        for got in batches:
            cols: list[tuple] = []
            for th, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if th not in seen:
                    seen.add(th)
                    found = []
                    for _, data in segments(as_bytes(text), length):
                        place, ids = chosen(data, length, gram)
                        found.append(ids[place[np.flatnonzero(np.diff(place, prepend=-1))]])
                    anchors, times = np.unique(np.concatenate(found), return_counts=True) if found else ((), ())
                    if found:
                        cols.append((anchors.view(np.int64), np.full(len(anchors), th), times.astype(np.int32)))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*cols, strict=True), out, strict=True)], schema=out)

    return scratch.keep(rows.where(F.octet_length("text") >= length).select("th", "text").mapInArrow(cm.frugal(run), "anchor long, th long, times int"))


def stretches(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """``(anchor, hot, th, start, windows, place, cid, stretch)``: the bytes of all windows that chose a suffix whose bucket is shared.

    ``place`` is where the chosen suffix starts in it; ``cid`` names the stretch's content, and a task sends the bytes of a content once.
    """
    out = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("place", pa.int32()), ("cid", pa.int64()), ("stretch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for got in batches:
            cols: dict[str, list] = {f.name: [] for f in out}
            for th, text, anchors, hot in zip(*(got.column(k).to_pylist() for k in range(4)), strict=True):
                both = np.array([*anchors, *hot], np.int64)
                heated = np.array(hot, np.int64)
                for at, data in segments(as_bytes(text), length):
                    place, ids = chosen(data, length, gram)
                    first = np.flatnonzero(np.diff(place, prepend=-1))
                    last = np.append(first[1:], len(place))
                    bucket = ids[place[first]].view(np.int64)
                    pick = np.isin(bucket, both)
                    prefix = hashing.running(data)
                    starts, ends = first[pick], last[pick] + length - 1
                    cid = hashing.pair(hashing.substrings(prefix, starts, ends), (place[first[pick]] - starts).astype(np.uint64)).view(np.int64)
                    raw = data.tobytes()
                    for a, b, e, w, o, c, h in zip(bucket[pick].tolist(), starts.tolist(), ends.tolist(), (last[pick] - starts).tolist(), (place[first[pick]] - starts).tolist(), cid.tolist(), np.isin(bucket[pick], heated).tolist(), strict=True):
                        known = c in sent and not h
                        sent.add(c)
                        for name, v in zip(out.names, (a, h, th, at + b, w, o, c, None if known else raw[b:e]), strict=True):
                            cols[name].append(v)
                    if len(cols["th"]) >= 8 * CHUNK:
                        yield cm.batch(out, cols)
                        cols = {f.name: [] for f in out}
            yield cm.batch(out, cols)

    near = rows.alias("d").join(wanted.alias("w"), (F.col("d.th") == F.col("w.th")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return near.select("w.th", "d.text", "w.anchors", "w.hot").mapInArrow(cm.frugal(run), "anchor long, hot boolean, th long, start long, windows int, place int, cid long, stretch binary")


def window_ids(parts: list[bytes], windows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Identifiers of all windows of the stretches in turn, refined from ``gram`` to ``length`` bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ids, depth = hashing.grams(hashing.running(data), gram), gram
    while depth < length:
        step = min(depth, length - depth)
        ids = hashing.pair(ids[: len(ids) - step], ids[step:])
        depth += step
    ends = np.cumsum([len(p) for p in parts])
    base = np.repeat(ends - [len(p) for p in parts], windows)
    return ids[base + np.arange(len(base)) - np.repeat(np.cumsum(windows) - windows, windows)]


def refine(parts: list[bytes], windows: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For every stretch which of its windows another stretch, or another place of it, holds too."""
    own = np.concatenate([window_ids(parts[a : a + CHUNK], windows[a : a + CHUNK], length, gram) for a in range(0, len(parts), CHUNK)])
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return np.split(twice, np.cumsum(windows)[:-1])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def refine_buckets(found: DataFrame, length: int, gram: int) -> DataFrame:
    """``(th, start, stop)``: runs of repeated windows, bucket by bucket, in tasks that hold whole buckets."""
    out = pa.schema([("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def work(rows: list[tuple]) -> pa.RecordBatch:
        places: dict[int, set] = {}
        bytes_of: dict[int, tuple] = {}
        for _, th, start, windows, cid, stretch in rows:
            places.setdefault(cid, set()).add((th, start, windows))
            if stretch is not None:
                bytes_of.setdefault(cid, (stretch, windows))
        cids = list(bytes_of)
        masks = refine([bytes_of[c][0] for c in cids], np.array([bytes_of[c][1] for c in cids]), length, gram) if cids else []
        made: list[tuple] = []
        for cid, mask in zip(cids, masks, strict=True):
            firsts, lasts = runs_of(np.ones(len(mask), bool) if len(places[cid]) > 1 else mask)
            made += [(th, start + a, start + b) for th, start, _ in places[cid] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]
        return cm.batch(out, {n: [m[k] for m in made] for k, n in enumerate(out.names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for got in batches:
            cols = got.to_pydict()
            for row in zip(*cols.values(), strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return found.select("anchor", "th", "start", "windows", "cid", "stretch").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(cm.frugal(run), "th long, start long, stop long")


def refine_hot(found: DataFrame, length: int, gram: int, scratch: cm.Scratch) -> DataFrame:
    """The same runs for hot buckets, by counting the bytes that ranges of windows have in common and span.

    A window is known by its distance before the chosen suffix, so equal windows lie in equal ranges.
    """
    lo, hi, place, windows = (F.col(c) for c in ("lo", "hi", "place", "windows"))
    part = lambda at, n: F.xxhash64(F.substring(F.col("stretch"), at + 1, n), n)
    held = (hi >= place - windows + 1) & (lo <= place)
    covered = (hi <= place) & (lo >= place - windows + 1)
    keep = ["th", "start", "windows", "place", "stretch", "known"]
    ranges = found.dropDuplicates(["th", "start"]).withColumn("known", F.lit(False)).select(*keep, F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    done: DataFrame | None = None
    read: list[str] = []
    while True:
        named = scratch.keep(ranges.withColumns({"core": part(place - lo, F.lit(length) - (hi - lo)), "hull": F.when(covered, part(place - hi, F.lit(length) + (hi - lo)))}))
        scratch.drop(read)
        if named.isEmpty():
            return done if done is not None else named.select("th", "start", F.col("start").alias("stop"))
        first = F.min(F.struct("th", "start")).alias("first")
        shared = named.groupBy("core").agg(F.count("*").alias("n"), F.bool_or(~F.col("known")).alias("open")).where("n > 1 AND open").select("core")
        whole = named.where("hull IS NOT NULL").groupBy("hull").agg(F.count("*").alias("n"), first).where("n > 1").select("hull", "first")
        rated = scratch.keep(named.join(shared, "core").join(whole, "hull", "left").withColumn("all", F.col("first").isNotNull()))
        read = scratch.paths[-2:]
        made = scratch.keep(rated.where("all AND NOT known").select("th", (F.col("start") + place - hi).alias("start"), (F.col("start") + place - lo + 1).alias("stop")))
        done = made if done is None else done.union(made)
        # Ranges found repeated go on as partners of others, one for each content; the rest is halved.
        onward = rated.where((lo < hi) & (~F.col("all") | (F.struct("th", "start") == F.col("first")))).withColumn("known", F.col("known") | F.col("all"))
        middle = F.floor((lo + hi) / 2).cast("int")
        halves = F.explode(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi"))))
        ranges = onward.select(*keep, halves.alias("r")).select(*keep, "r.lo", "r.hi").where(held)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(th, copies, runs)`` for every text that may lose bytes: its number of copies and its runs of repeated windows."""
    return repeats_of(keyed(docs), length, gram, hot)


def repeats_of(rows: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """``repeats`` of ``(doc_id, th, text)`` rows; texts may be binary."""
    cm.small_batches(rows.sparkSession)
    rows = rows.where(F.octet_length("text") >= length)
    scratch = cm.Scratch(rows.sparkSession, "suffix-dedup")
    buckets = first_buckets(rows, length, gram, scratch)
    shared = buckets.groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("times").alias("times"), F.sum("times").alias("n")).where(
        "lo <> hi OR times > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    shared = scratch.keep(shared)
    texts = scratch.keep(rows.groupBy("th").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").alias("doc_id"))).alias("one")))
    listed = buckets.join(shared, "anchor").groupBy("th").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = listed.join(texts, "th").select("th", "one.doc_id", "anchors", "hot")
    found = stretches(rows, wanted, length, gram)
    if shared.where("hot").isEmpty():
        runs = refine_buckets(found, length, gram)
    else:
        found = scratch.keep(found)
        runs = refine_buckets(found.where(~F.col("hot")), length, gram).union(refine_hot(found.where("hot"), length, gram, scratch))
    gathered = runs.groupBy("th").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    done = cm.saved(texts.select("th", "copies", F.col("one.doc_id").alias("one")).join(gathered, "th", "left").where("copies > 1 OR runs IS NOT NULL"))
    scratch.drop()
    return done


def removed_mask(size: int, copies: int | None, runs: list | None, length: int) -> np.ndarray:
    """Which bytes of a text go."""
    if copies is not None and copies > 1 and size >= length:
        return np.ones(size, bool)
    depth = np.zeros(size + 1, np.int32)
    for r in runs or ():
        depth[r["start"]] += 1
        depth[r["stop"] - 1 + length] -= 1
    return np.cumsum(depth[:-1]) > 0


def joined_runs(runs: list) -> list[tuple[int, int]]:
    """Runs that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def regions(docs: DataFrame, found: DataFrame, short: int, length: int) -> DataFrame:
    """``(owner, at, th, text)``: the stretches of distinct texts that can hold a repeat of ``length`` bytes.

    All windows of ``short`` bytes in such a repeat are repeated too, so it lies in a run of at least
    ``length - short + 1`` of them, and so does its other place.
    """
    out = pa.schema([("owner", pa.int64()), ("at", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for owner, text, runs in zip(*(c.to_pylist() for c in got.columns), strict=True):
                data = as_bytes(text)
                made = [(owner, a, data[a : b - 1 + short].tobytes()) for a, b in joined_runs(runs) if b - a > length - short]
                yield cm.batch(out, {n: [m[k] for m in made] for k, n in enumerate(out.names)})

    one = keyed(docs).join(found.where("runs IS NOT NULL").select("th", "one", "runs"), "th").where(F.col("doc_id").eqNullSafe(F.col("one")))
    once = one.select("th", "text", "runs").mapInArrow(cm.frugal(run), "owner long, at long, text binary").dropDuplicates(["owner", "at"])
    path = cm.scratch_table(docs.sparkSession, "suffix-regions")
    once.select("owner", "at", F.xxhash64("text").alias("th"), "text").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def longer_repeats(docs: DataFrame, found: DataFrame, short: int, length: int, gram: int) -> DataFrame:
    """``(th, longer)``: the runs of repeated windows of ``length`` bytes, refined from those of ``short`` bytes in ``found``."""
    parts = regions(docs, found, short, length)
    inner = repeats_of(parts.select(F.xxhash64("owner", "at").alias("doc_id"), "th", "text"), length, gram)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.octet_length("text") - length + 1).cast("long").alias("stop")))
    runs = F.when(F.col("copies") > 1, whole).otherwise(F.col("runs"))
    placed = parts.join(inner, "th").select(F.col("owner").alias("th"), F.explode(F.transform(
        runs, lambda r: F.struct((r["start"] + F.col("at")).alias("start"), (r["stop"] + F.col("at")).alias("stop")))).alias("r"))
    return placed.groupBy("th").agg(F.collect_list("r").alias("longer"))


def digests(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Per row: bytes, bytes removed, removed runs and the digest of what is kept; and bytes and runs of repeats from ``passage`` bytes."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                     ("n_passage_bytes", pa.int64()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for key, text, copies, runs, longer in zip(*(c.to_pylist() for c in got.columns), strict=True):
                data = as_bytes(text)
                gone, again = removed_mask(len(data), copies, longer, length), removed_mask(len(data), copies, runs, passage)
                rows.append((key, len(data), int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest(), int(again.sum()), len(runs_of(again)[0])))
            yield cm.batch(out, {n: [r[k] for r in rows] for k, n in enumerate(out.names)})

    found = repeats(docs, passage, PASSAGE_GRAM)
    longer = longer_repeats(docs, found, passage, length, GRAM)
    joined = keyed(docs).join(found.join(longer, "th", "left"), "th", "left").select("doc_id", "text", "copies", "runs", "longer")
    return joined.mapInArrow(cm.frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``; a character cut in two goes whole, ``n_chars`` follows."""
    names = docs.columns
    found = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th")).join(repeats(docs, length, gram).drop("one").withColumnsRenamed({"th": "__th", "copies": "__copies", "runs": "__runs"}), "__th", "left")
    schema = found.select(*[F.col(f"`{n}`") for n in names]).schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for a, b in cm.slices(got.column(at), cm.BATCH_BYTES):
                part = got.slice(a, b - a)
                cols = list(part.columns[: len(names)])
                texts = []
                for text, copies, runs in zip(cols[at].to_pylist(), part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                    data = as_bytes(text or "")
                    gone = removed_mask(len(data), copies, runs, length)
                    texts.append(text if not gone.any() else data[~gone].tobytes().decode("utf-8", "ignore"))
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = found.select(*[F.col(f"`{n}`") for n in names], "__copies", "__runs").mapInArrow(cm.frugal(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out

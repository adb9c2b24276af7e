"""Word n-gram Jaccard self-join by prefix filters under several global token orders.

A text is the set of its distinct shingles. Two sets that reach the threshold share a token among the
first ``n - ceil(J * n) + 1`` of each, under *any* order of all tokens. Candidates must pass the filter under
three orders at once: rare tokens first, and two pseudo-random orders. What all three let through is
verified on the whole sets.

1. Texts of equal sets form a class, and only classes are joined.
2. A cheap pass proves most classes lonely: of the tokens below a hash bound, whose frequency is
   counted exactly, more than a prefix are its own.
3. The rest is indexed in full under the rare-first order. Each class is first checked against one
   class that other texts of its buckets were copied from, and components are formed; then all pairs that
   share a prefix token across components are checked, first by parity bitmaps, which bound the
   difference of two sets from below, so a large group of near copies never emits all its pairs, and no
   link that could join two components is left out.

Hash identifiers have 64 bits. Defined cases: null text, or text without words, is an empty set and linked
with nothing; texts with fewer words than a shingle are one shingle; equal sets are linked; every input
row gives one row, so repeated rows repeat and share a component; a null ``doc_id`` is never the
smallest one of a component unless all are null; an empty table gives no rows; other input columns are
kept only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cutledger.llm import common as cm, hashing
from cutledger.llm.components import components

#: Tokens counted in the first pass, as a multiple of the share that a prefix takes.
COUNTED = 1.5
STARS = 2
#: Bits of the parity bitmap, and rows of a bucket that meet in one task, twice as many at most.
BITMAP, BLOCK = 2048, 1024
#: A text with a word has a character that is no ASCII white space.
BLACK = r"[^\x20\x09-\x0D]"


def counted_below(percent: int) -> int:
    """Hashes below this bound are counted in the first pass."""
    return int(min(1.0, COUNTED * (100 - percent) / 100) * (2**64 - 1))


def prefix_length(n, percent: int):
    """``n - ceil(percent / 100 * n) + 1`` for numbers and numpy arrays."""
    return n - -(-percent * n // 100) + 1


def prefix_column(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100.0)).cast("long") + 1


def set_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``(doc_id, th, n, fp, counted)``: size and identifier of every row's set, and its tokens below the hash bound."""
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("counted", pa.int64())])
    bound = np.uint64(counted_below(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            sets = [hashing.shingles(t, size) for t in got.column(2).to_pylist()]
            yield cm.batch(out, {
                "doc_id": got.column(0), "th": got.column(1), "n": [len(s) for s in sets], "fp": [hashing.fingerprint(s) for s in sets],
                "counted": [int((s < bound).sum()) for s in sets]})

    return cm.saved(keyed(docs).mapInArrow(cm.frugal(run), "doc_id long, th long, n long, fp long, counted long"))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, text)`` with a hash of the text beside it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def counted_tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``(token, fp)`` of the first pass: tokens below the hash bound, or enough of the least hashes for a prefix."""
    out = pa.schema([("token", pa.int64()), ("fp", pa.int64())])
    bound = np.uint64(counted_below(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task are written once; bounded by the task's rows
        for got in batches:
            tokens, owners = [], []
            for text in got.column(0).to_pylist():
                s = hashing.shingles(text, size)
                fp = hashing.fingerprint(s)
                if len(s) and fp not in seen:
                    seen.add(fp)
                    tokens.append(s[: max(int((s < bound).sum()), prefix_length(len(s), percent))].view(np.int64))
                    owners.append(np.full(len(tokens[-1]), fp))
            if tokens:
                yield cm.batch(out, {"token": np.concatenate(tokens), "fp": np.concatenate(owners)})

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cm.frugal(run), "token long, fp long")


def with_frequency(tokens: DataFrame) -> DataFrame:
    """Rows of tokens that several classes hold, with ``df``; each class at most once a token."""
    own = Window.partitionBy("token")
    marked = tokens.withColumns({"df": F.count("*").over(own), "lo": F.min("fp").over(own), "hi": F.max("fp").over(own)})
    return marked.where("lo <> hi").select("token", "fp", "df")


def survivors(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``(fp, n, doc_id, th)`` of classes that may have a partner, with one row that holds the set."""
    below = F.shiftrightunsigned(F.col("token"), 1) < F.lit(counted_below(percent) >> 1)
    shared = with_frequency(counted_tokens(docs, size, percent)).groupBy("fp").agg(
        F.count_distinct(F.when(below, F.col("token"))).alias("known"), F.count("*").alias("any"))
    holder = sets.where("n > 0").groupBy("fp").agg(F.min(F.struct("n", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").alias("doc_id"), "th", "counted")).alias("r"))
    joined = holder.select("fp", "r.*").join(shared, "fp")
    return cm.saved(joined.where(F.col("counted") - F.col("known") < prefix_column(F.col("n"), percent)).select("fp", "n", "doc_id", "th"))


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """``(fp, n, tokens, second, third, bits)``: whole sets, their prefixes under the two pseudo-random orders, and a parity bitmap."""
    out = pa.schema([("fp", pa.int64()), ("n", pa.int64())] + [(k, pa.list_(pa.int64())) for k in ("tokens",)] + [(k, pa.list_(pa.int32())) for k in ("second", "third")] + [("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()  # repeated rows of one document meet in one task
        for got in batches:
            cols: dict[str, list] = {f.name: [] for f in out}
            for fp, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                s = hashing.shingles(text, size) if fp not in made else ()
                if len(s) and hashing.fingerprint(s) == fp:
                    made.add(fp)
                    p = prefix_length(len(s), percent)
                    # The order's own hash names a token here; half of it is enough for a filter that may let more through.
                    orders = [np.sort(hashing.mix(s + np.uint64(k)))[:p] >> np.uint64(24) for k in (101, 202)]
                    bits = np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % BITMAP, minlength=BITMAP).astype(np.uint8) & 1).tobytes()
                    for name, v in zip(out.names, (fp, len(s), s.view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in orders), bits), strict=True):
                        cols[name].append(v)
            yield cm.batch(out, cols)

    near = keyed(docs).alias("d").join(wanted.alias("w"), (F.col("d.th") == F.col("w.th")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    found = near.select("w.fp", "d.text").mapInArrow(cm.frugal(run), "fp long, n long, tokens array<long>, second array<int>, third array<int>, bits binary")
    return cm.saved(found)


def rare_first_prefix(whole: DataFrame, percent: int) -> DataFrame:
    """``(token, fp, n, own)``: the shared tokens among each class's prefix when rare tokens come first.

    ``own`` is the share of tokens no other class has.
    """
    rows = with_frequency(whole.select(F.explode("tokens").alias("token"), "fp"))
    listed = rows.groupBy("fp").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("shared"))
    taken = prefix_column(F.col("n"), percent) - (F.col("n") - F.size("shared"))
    # Tokens of its own come first and match nothing; the rest of the prefix is shared tokens, rarest first.
    kept = listed.join(whole.select("fp", "n"), "fp").where(taken > 0).select(
        "fp", "n", (1 - F.size("shared") / F.col("n")).alias("own"), F.explode(F.slice("shared", F.lit(1), taken.cast("int"))).alias("t"))
    return cm.saved(kept.select("fp", "n", "own", "t.token"))


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that pass the prefix filters of the other orders and then reach the threshold."""
    orders = whole.select("fp", "second", "third")
    left, right = (orders.select(F.col("fp").alias(k), F.col("second").alias(f"s{k}"), F.col("third").alias(f"t{k}")) for k in "ab")
    few = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb")).select("a", "b")
    left, right = (whole.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"w{k}")) for k in "ab")
    both = few.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("wa", "wb")).cast("long"))
    return both.where(F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent).select("a", "b")


def near_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's rows ``(token, fp, n, label, bits)`` with different labels that may reach the threshold.

    Two parity bitmaps differ in no more bits than the sets have tokens that the other one lacks, so a pair
    whose bitmaps differ too much is no link and isn't written. Large buckets meet block by block.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(group: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp, n, label, side = (np.array([g[k] for g in group], np.int64) for k in range(4))
        bits = np.frombuffer(b"".join(g[4] for g in group), np.uint64).reshape(len(group), -1)
        for i in range(len(group) - 1):
            rest = np.arange(i + 1, len(group))
            apart = (label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])) & ((side[rest] != side[i]) | (side[i] < 0))
            rest = rest[apart]
            if len(rest):
                differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
                rest = rest[differ * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)]
                yield np.full(len(rest), fp[i]), fp[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush() -> pa.RecordBatch:
            made = list(meet(group))
            a, b = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in (0, 1))
            return cm.batch(out, {"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for got in batches:
            for token, x, y, *row in zip(*got.to_pydict().values(), strict=True):
                if (token, x, y) != key and group:
                    yield flush()
                    group = []
                key = (token, x, y)
                group.append(row)
        if group:
            yield flush()

    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    # A block also meets itself, in a group of its own.
    met = dealt.select("token", x.alias("x"), y.alias("y"), "fp", "n", "label", side.cast("long").alias("side"), "bits")
    return met.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(cm.frugal(run), "a long, b long")


def links(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes that span the components of the whole join."""
    whole = whole_sets(docs, survivors(docs, sets, size, percent), size, percent)
    index = rare_first_prefix(whole, percent)
    close = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Of each bucket the class with the fewest tokens of its own: what others were copied from.
    centre = index.groupBy("token").agg(F.min(F.struct("own", F.xxhash64("fp").alias("h"), F.col("fp").alias("b"), F.col("n").alias("nb"))).alias("c"))
    met = index.join(centre, "token").where((F.col("fp") != F.col("c.b")) & close("n", "c.nb"))
    stars = met.groupBy("fp").agg(F.slice(F.array_sort(F.collect_set("c")), 1, STARS).alias("cs")).select(F.col("fp").alias("a"), F.explode("cs.b").alias("b"))
    first = cm.saved(verified(ordered(stars), whole, percent))
    label = components(first)
    placed = index.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", F.coalesce("label", "fp").alias("label"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    across = near_pairs(placed.join(mixed, "token").join(whole.select("fp", "bits"), "fp"), percent)
    return first.union(verified(ordered(across), whole, percent))


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, th, n_shingles, component_id, label)`` for every row; ``component_id`` is the smallest linked ``doc_id``.

    ``label`` names the component also where no row of it has a ``doc_id``; it is null for empty sets.
    """
    cm.small_batches(docs.sparkSession)
    sets = set_rows(docs, size, percent)
    label = components(links(docs, sets, size, percent))
    classes = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = named.groupBy("label").agg(F.min("least").alias("component"))
    members = named.join(groups, "label").select("fp", "label", "component")
    return sets.join(members, "fp", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest ``doc_id`` (then text hash); empty sets all stay."""
    joined = join(docs, size, percent)
    key = lambda p="": (F.coalesce(F.col(f"{p}doc_id"), F.lit(0)).alias("__id"), F.col(f"{p}doc_id").isNull().alias("__none"), F.col(f"{p}th").alias("__th"))
    first = joined.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("i"), "doc_id", "th")).alias("r")).select(*key("r."))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).select("__row", *key())
    bare = rows.where(~F.coalesce(F.col("__row.text").rlike(BLACK), F.lit(False)))
    one = rows.where(F.col("__row.text").rlike(BLACK)).join(first, ["__id", "__none", "__th"]).dropDuplicates(["__id", "__none", "__th"])
    return one.select("__row.*").unionByName(bare.select("__row.*"))

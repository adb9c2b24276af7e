"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The hash's low bits name one of ``BINS`` bins, the
remaining bits are its value, and each bin keeps its least value. A bin without a shingle borrows from
a bin that a fixed probe sequence of its own hits first (optimal densification; after ``PROBES`` tries
the next filled bin to the right). A fingerprint stores the low ``BITS`` bits of every bin. Two random
bins agree with probability 2**-BITS, which the likeness corrects for.

Neighbours in ascending ``doc_id`` are brought together by one shuffle of the texts: rows go to blocks
between quantiles of ``doc_id``, a window hands each row its follower, and the last row of a block
gets the first row of the next block, of which there is one a block.

Defined cases: null text counts as empty; a text with fewer than five words is one shingle; without
words a fingerprint is empty, alike (1.0) to another empty one and unlike (0.0) any other; rows of equal
``doc_id`` follow each other by text; null ``doc_id`` comes first; a single row is its own follower; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutledger.llm import common as cm

BINS, BITS, WORDS, PROBES = 128, 8, 5, 12
MAX_BLOCKS = 512


def borrowing(bins: int = BINS, probes: int = PROBES) -> list[list[int]]:
    """Bins each empty bin borrows from, by multiplicative hashing of bin and attempt."""
    rows = []
    for b in range(bins):
        x, row = b + 1, []
        for _ in range(probes):
            x = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
            row.append((x >> 40) % bins)
        rows.append(row)
    return rows


def with_fingerprint(df: DataFrame, text: str, name: str, size: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add ``name``: the array of the low bits of all bins of column ``text``; empty without words.

    Each step is a column of its own, so none is computed again inside another's function.
    """
    low = (1 << bits) - 1
    h, o, f, d = (f"__{name}_{k}" for k in "hofd")
    run = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(size)])
    # The bin goes to the top bits, so that after sorting the first of each bin is its least value.
    keyed = lambda x: F.shiftleft(x.bitwiseAND(F.lit(bins - 1)), 48) + F.shiftrightunsigned(x, 16)
    bin_of = lambda x: F.shiftright(x, 48).cast("int")
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    lenders = F.from_json(F.lit(json.dumps(borrowing(bins))), "array<array<int>>")
    lent = lambda rows: F.get(F.filter(rows, lambda v: v.isNotNull()), F.lit(0))
    filled = lambda b: F.coalesce(
        F.get(F.col(d), b), lent(F.transform(F.get(lenders, b), lambda j: F.get(F.col(d), j))),
        lent(F.transform(every, lambda j: F.get(F.col(d), F.pmod(b + j, F.lit(bins))))))
    df = df.withColumn(h, F.transform(cm.words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(o, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: keyed(run(i)))))
    df = df.withColumn(f, F.filter(o, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(o), i - 1)))))
    df = df.withColumn(f, F.map_from_entries(F.transform(f, lambda x: F.struct(bin_of(x), x.bitwiseAND(F.lit(low)).cast("int")))))
    df = df.withColumn(d, F.when(F.size(f) > 0, F.transform(every, lambda b: F.try_element_at(F.col(f), b))))
    df = df.withColumn(name, F.when(F.size(h) > 0, F.transform(every, filled)).otherwise(F.array().cast("array<int>")))
    return df.drop(h, o, f, d)


def packed(fingerprint: Column, bits: int = BITS) -> Column:
    """Low bits of all bins as hexadecimal digits."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), bits // 4, "0"))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated share of common shingles: agreement of bins less what chance gives."""
    chance = 2.0**-bits
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"])) / F.greatest(F.size(a), F.lit(1))
    rated = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(rated)


def with_follower(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_text)`` with the text of the next row by ``doc_id``; the last row's is the first row's."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, min(MAX_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    block = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("block", block)
    # The first row of every block, by doc_id (null first) and text: as many rows as there are blocks.
    least = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("least"))
    at = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    heads = (
        rows.withColumn("at", at).join(F.broadcast(least.select("block", F.col("least").alias("at"))), ["block", "at"])
        .groupBy("block").agg(F.min("text").alias("head")))
    ring = Window.orderBy("block")
    after = heads.select("block", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    inside = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), "text")
    placed = rows.withColumn("follower", F.lead("text").over(inside))
    return placed.join(after, "block").select("doc_id", "text", F.coalesce("follower", "after").alias("next_text"))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited form, and how alike it is to both neighbours."""
    df = with_follower(docs)
    n = F.length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, cast(length(text) div 2 as int))")))
    for text, name in (("text", "own"), ("edited", "changed"), ("next_text", "next")):
        df = with_fingerprint(df, text, name)
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))

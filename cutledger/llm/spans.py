"""Located pattern matches as arrays of spans, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hits(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, found: Column, pattern: str) -> Column:
    """``array<struct<start, end, m>>`` of ``found = hits(text, pattern)``, in code points, end exclusive.

    The text between matches comes from splitting at the pattern; a running sum of both lengths gives
    each start. Texts without a match are not split.
    """
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    walked = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def label(found: Column, kind: int) -> Column:
    """Spans as ``struct<kind, start, end>`` with the number of their kind."""
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spelled(found: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that touch none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))

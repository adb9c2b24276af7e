"""Secret scans: fixed-form secrets, and credentials pieced together from parts, in DataFrame functions.

Base spans (assign, access, hex) are exact rules and always stay. Weaker parts - account identifiers,
varied strings of any length and endpoints - say little alone. They are joined by interval: a weak secret is
reported only if an identifier (or access key) lies within ``SCOPE`` code points of it and an endpoint
does as well. Positions fall into bins of ``SCOPE``; a span covers every bin from its start to its end,
reaches one ``SCOPE`` further on both sides, and then the distance decides.

Defined cases: null text counts as empty (no spans); rows are independent, so repeated rows repeat; an
empty table gives no rows; other input columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutledger.llm import spans as sp

BASE = ["assign", "access", "hex"]
#: The base patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}+", "hex": "[0-9a-f]{24,}+"}
PARTS = ["weak_secret", "identifier", "endpoint"]
PART_PATTERNS = {
    "weak_secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
    "identifier": r"(?i:user(?:name|_?id)?|login|client_?id|account_?id)[\"']? *[:=] *[\"']?[A-Za-z0-9@._-]{3,64}+",
    "endpoint": r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]{3,200}+(?::[0-9]{2,5})?",
}
KINDS = BASE + PARTS
SCOPE = 200
#: Bits a character from which a piece of a run counts as varied; prose words of 16 letters seldom reach it.
ENTROPY = 3.0


def entropy(m: Column) -> Column:
    """Bits a character of a string, from how often each of its characters occurs."""
    n = F.length(m)
    count = lambda c: n - F.length(F.replace(m, c, F.lit("")))
    signs = F.array_distinct(F.regexp_extract_all(m, F.lit("."), F.lit(0)))
    return F.aggregate(signs, F.lit(0.0), lambda acc, c: acc - count(c) / n * F.log2(count(c) / n))


def varied(m: Column) -> Column:
    """Whether a run may be a secret: digits and capitals, or a piece without ``/`` and ``=`` of 16 characters with enough entropy."""
    pieces = F.regexp_extract_all(m, F.lit("[A-Za-z0-9+_-]{16,}+"), F.lit(0))
    return (m.rlike("[0-9]") & m.rlike("[A-Z]")) | F.exists(pieces, lambda p: entropy(p) >= ENTROPY)


def near(parts: Column, others: Column, scope: int) -> Column:
    """The parts with one of the others at most ``scope`` code points away, joined by bin and then by distance."""
    bin_of = lambda at: F.floor(at / scope).cast("int")
    bins = F.array_distinct(F.flatten(F.transform(others, lambda o: F.sequence(bin_of(o["start"] - scope), bin_of(o["end"] + scope)))))
    covers = lambda s: F.sequence(bin_of(s["start"]), bin_of(s["end"]))
    return F.filter(parts, lambda s: F.arrays_overlap(covers(s), bins) & F.exists(
        others, lambda o: (F.greatest(o["start"], s["start"]) - F.least(o["end"], s["end"])) <= scope))


def find(docs: DataFrame, *keep: str, scope: int = SCOPE) -> DataFrame:
    """``keep`` columns, ``n_<kind>`` of base spans, ``base`` and ``found`` spans sorted by start, then kind."""
    t = F.col("__t")
    every = PATTERNS | PART_PATTERNS
    df = docs.select(*[F.col(k) for k in keep], F.coalesce("text", F.lit("")).alias("__t"))
    df = df.withColumns({f"__h_{k}": sp.hits(t, every[k]) for k in KINDS if k != "weak_secret"})
    # Without an endpoint and an identifier no weak secret can be linked, so it needn't be looked for.
    linkable = (F.size("__h_endpoint") > 0) & ((F.size("__h_identifier") > 0) | (F.size("__h_access") > 0))
    df = df.withColumn("__h_weak_secret", F.when(linkable, sp.hits(t, every["weak_secret"])).otherwise(F.array().cast("array<string>")))
    # The base kinds are located always, the parts only in texts with a weak secret.
    linked = F.size("__h_weak_secret") > 0
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    df = df.withColumns({f"__s_{k}": sp.located(t, F.col(f"__h_{k}"), every[k]) for k in BASE}
                        | {f"__s_{k}": F.when(linked, sp.located(t, F.col(f"__h_{k}"), every[k])).otherwise(none) for k in PARTS})
    df = df.withColumn("__s_assign", F.filter("__s_assign", lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 6))
    inside = lambda s: F.exists("__s_identifier", lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]))
    df = df.withColumn("__s_weak_secret", F.filter("__s_weak_secret", lambda s: varied(s["m"]) & ((s["m"].rlike("[0-9]") & s["m"].rlike("[A-Z]")) | ~inside(s))))
    base = F.concat(*[sp.label(F.col(f"__s_{k}"), i) for i, k in enumerate(BASE)])
    who = F.concat("__s_identifier", "__s_access")
    weak = near(near(F.col("__s_weak_secret"), who, scope), F.col("__s_endpoint"), scope)
    df = df.withColumns({"__base": base, "__weak": F.when(linked, weak).otherwise(none)})
    shown = lambda k: near(F.col(f"__s_{k}"), F.col("__weak"), scope)
    parts = F.when(F.size("__weak") > 0, F.concat(
        sp.label(F.col("__weak"), 3), sp.label(shown("identifier"), 4), sp.label(shown("endpoint"), 5))).otherwise(
        F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    by_start = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"]))),
                                     lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("__all", F.concat("__base", sp.apart(parts, F.col("__base"))))
    return df.select(*keep, *[F.size(f"__s_{k}").cast("long").alias(f"n_{k}") for k in BASE], by_start(F.col("__base")).alias("base"), by_start(F.col("__all")).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return find(docs, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), *[f"n_{k}" for k in BASE],
        F.sha2(sp.spelled(F.col("base"), KINDS), 256).alias("base_sha256"), sp.spelled(F.col("found"), KINDS).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; other columns stay, texts without a span too."""
    rest = [F.col(f"`{c}`") for c in docs.columns]
    df = find(docs.select(F.struct(*rest).alias("__row"), F.col("text").alias("text")).select("__row", "text"), "__row", "text")
    t = F.col("text")
    kept = F.aggregate(
        F.col("found"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    cleaned = F.when(F.size("found") > 0, kept).otherwise(t)
    columns = {f: F.col(f"__row.`{f}`") for f in docs.columns} | {"text": cleaned}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("found") > 0, F.length(cleaned).cast("long")).otherwise(columns["n_chars"])
    return df.select(*[c.alias(f) for f, c in columns.items()])

"""Personal data: high-recall span proposals, scored by gradient-boosted trees, in DataFrame functions.

Base spans (email, ip, card, phone) are exact rules and always stay. Generators propose further,
overlapping spans. Every proposal gets features of its format and its context; boosted trees of two
splits score it, and per kind only scores above a threshold calibrated on proposals the trees have not
seen become spans. The trees are column expressions, so scoring is part of the scan.

Training is distantly supervised. Base spans are positives. Proposals of the added kinds are labelled by a
check of their own: the IBAN's remainder by 97, the ranges of an id, a mail address spelled in words
that resolves to a domain form; a local phone number needs a phone's form and a phone word before it.
What fails is a negative. The check (for phones the form alone) and the context are features. Each kind
has its own threshold. The sample is bounded: proposals of ``TRAIN_DOCS`` distinct texts, dealt over
the kinds they hold, at most ``TRAIN_SPANS``, and a fixed set of made-up spans that pass or fail
(``exemplars``), so a kind the sample lacks is learned as well.

Defined cases: null text counts as empty (no spans); rows are independent, so repeated rows repeat; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cutledger.llm import common as cm, spans as sp

BASE = ["email", "ip", "card", "phone"]
#: The base patterns. Possessive forms match the same spans without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = ["mail_words", "phone_local", "iban", "id_number"]
PROPOSALS = {
    "mail_words": r"[A-Za-z0-9._%+-]{2,40} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,40} ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,10}",
    "phone_local": r"(?<![0-9.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id_number": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = BASE + MORE
#: Words before a span that speak for its kind.
PHONE_WORDS = r"(?i)(phone|tel\b|tel[.:]|mobile|call|fax|contact|reach)"
CONTEXT = {
    "email": r"(?i)(mail|contact|reach|write to|address)", "mail_words": r"(?i)(mail|contact|reach|write to|address)", "ip": r"(?i)(ip\b|address|host)",
    "card": r"(?i)(card|account|pay)", "phone": PHONE_WORDS, "phone_local": PHONE_WORDS, "iban": r"(?i)(iban|account|bank)", "id_number": r"(?i)(ssn|social|\bid\b)",
}
FEATURES = ["digits", "letters", "marks", "groups", "size", "word_before", "word_after", "hint", "family", "valid"]
#: Kinds of like format.
FAMILY = {"email": 0, "mail_words": 0, "ip": 1, "card": 2, "iban": 2, "phone": 3, "phone_local": 3, "id_number": 3}
#: Of one text so many proposals of a kind are learned from at most.
PER_TEXT = 20
TRAIN_DOCS, TRAIN_SPANS, ROUNDS, RATE, PRECISION = 2000, 20_000, 24, 0.3, 0.98


def base_spans(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns of raw matches, and the filters that keep the valid ones by kind."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["m"].rlike(rf"\A{byte}(?:\.{byte}){{3}}\z"),
        "card": lambda s: (F.length(digits(s["m"])) <= 19) & F.call_function("luhn_check", digits(s["m"])),
        "phone": lambda s: F.length(digits(s["m"])).between(9, 15),
    }
    return {k: sp.hits(text, PATTERNS[k]) for k in BASE}, valid


def by_kind(kind: Column, values: dict[str, Column]) -> Column:
    """The value of the span's kind; each is computed for its own kind only."""
    out = F.lit(True)
    for k, v in values.items():
        out = F.when(kind == KINDS.index(k), v).otherwise(out)
    return out


def remainder(m: Column) -> Column:
    """Of an IBAN by 97, its first four characters last and letters as 10 to 35."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    signs = F.regexp_extract_all(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), F.lit("."), F.lit(0))
    value = lambda c: F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(signs, F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def checked(m: Column, kind: Column) -> Column:
    """Whether a span passes the check of its kind; base spans did already."""
    spelled = F.regexp_replace(m, r" ?[\[(](?:at|AT)[\])] ?", "@")
    mail = F.regexp_replace(spelled, r" ?[\[(](?:dot|DOT)[\])] ?", ".")
    name = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    date = r"\A(?:[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-][0-9]{2,4}|[0-9]{4}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2})\z"
    return by_kind(kind, {
        "mail_words": mail.rlike(rf"\A[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@{name}\.[A-Za-z]{{2,10}}\z"),
        "phone_local": digits.between(7, 15) & ~m.rlike(date) & ~m.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"),
        "iban": F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (remainder(m) == 1),
        "id_number": m.rlike(r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\z"),
    })


def features(text: Column, span: Column, family: Column) -> Column:
    """Format and context of one span, as small integers."""
    m = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    before = F.substring(text, F.greatest(span["start"] - 39, F.lit(1)), F.least(span["start"], F.lit(40)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(m, pattern, ""))
    values = {
        "digits": left("[^0-9]"), "letters": left("[^A-Za-z]"), "marks": left("[A-Za-z0-9]"),
        "groups": F.size(F.split(m, "[^A-Za-z0-9]+")), "size": F.length(m), "word_before": before.rlike(r"[A-Za-z0-9]\z").cast("int"),
        "word_after": after.rlike("[A-Za-z0-9]").cast("int"), "hint": by_kind(span["kind"], {k: before.rlike(p) for k, p in CONTEXT.items()}).cast("int"), "family": family,
        "valid": checked(m, span["kind"]).cast("int")}
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def proposed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with base spans by kind, their sorted list ``base`` and ``more``: proposals that touch none."""
    df = docs.select(*[F.col(k) for k in keep], F.coalesce("text", F.lit("")).alias("__t"))
    found, valid = base_spans(F.col("__t"))
    df = df.withColumns({f"__h_{k}": c for k, c in found.items()} | {f"__h_{k}": sp.hits(F.col("__t"), PROPOSALS[k]) for k in MORE})
    df = df.withColumns({f"__s_{k}": sp.located(F.col("__t"), F.col(f"__h_{k}"), (PATTERNS | PROPOSALS)[k]) for k in KINDS})
    df = df.withColumns({f"__s_{k}": F.filter(f"__s_{k}", valid[k]) for k in BASE})
    df = df.withColumn("base", F.concat(*[sp.label(F.col(f"__s_{k}"), i) for i, k in enumerate(BASE)]))
    return df.withColumn("more", sp.apart(F.concat(*[sp.label(F.col(f"__s_{k}"), len(BASE) + i) for i, k in enumerate(MORE)]), F.col("base")))


def described(column: str) -> Column:
    """Spans with their features."""
    families = F.array(*[F.lit(FAMILY[k]) for k in KINDS])
    return F.transform(column, lambda s: F.struct(s.alias("s"), features(F.col("__t"), s, F.get(families, s["kind"])).alias("f")))


@dataclass
class Boosted:
    """Trees ``(feature, cut, [(feature, cut), (feature, cut)], four leaf scores)`` and a threshold a kind."""

    base: float
    trees: list[tuple]
    thresholds: dict[int, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, cut, sides, leaves in self.trees:
            side = (x[:, f] > cut).astype(int)
            low = np.where(side == 0, x[:, sides[0][0]] > sides[0][1], x[:, sides[1][0]] > sides[1][1])
            out += np.array(leaves)[side * 2 + low]
        return out

    def column(self, f: Column) -> Column:
        value = F.lit(self.base)
        at = lambda i: f[FEATURES[i]]
        for i, cut, sides, leaves in self.trees:
            half = [F.when(at(j) > F.lit(float(c)), F.lit(leaves[2 * k + 1])).otherwise(F.lit(leaves[2 * k])) for k, (j, c) in enumerate(sides)]
            value = value + F.when(at(i) > F.lit(float(cut)), half[1]).otherwise(half[0])
        return value


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """Feature and cut with the largest gain of squared gradient sums."""
    best = (0.0, 0, float("inf"))
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        cuts, at = np.unique(x[:, f], return_inverse=True)
        gs, hs = np.cumsum(np.bincount(at, g, len(cuts))), np.cumsum(np.bincount(at, h, len(cuts)))
        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - total
        k = int(gain[:-1].argmax()) if len(cuts) > 1 else 0
        if len(cuts) > 1 and gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, float(cuts[k]))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION, kinds: np.ndarray | None = None) -> Boosted | None:
    """Fit trees on three quarters of the rows and set thresholds on the rest, by kind or else by family; None without both classes."""
    if len(y) < 8 or y.min() == y.max():
        return None
    learn = np.arange(len(y)) % 4 != 3
    rate0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(rate0 / (1 - rate0))), [], {})
    a, b = x[learn], y[learn]
    score = model.raw(a)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        _, f, cut = best_split(a, g, h)
        side = a[:, f] > cut
        sides, leaves = [], []
        for part in (~side, side):
            _, f2, cut2 = best_split(a[part], g[part], h[part]) if part.any() else (0, 0, float("inf"))
            sides.append((f2, cut2))
            for leaf in (part & (a[:, f2] <= cut2), part & (a[:, f2] > cut2)):
                leaves.append(float(rate * g[leaf].sum() / (h[leaf].sum() + 1)))
        tree = (f, cut, sides, leaves)
        model.trees.append(tree)
        score = score + Boosted(0.0, [tree], {}).raw(a)
    held, truth = model.raw(x[~learn]), y[~learn]
    groups = (x[:, FEATURES.index("family")] if kinds is None else kinds)[~learn]
    for group in sorted(set(FAMILY.values())) if kinds is None else range(len(KINDS)):
        own = groups == group
        s, t = held[own], truth[own]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(t) + 1) >= precision
        model.thresholds[group] = float(s[order][np.flatnonzero(good)[-1]]) if good.any() else float("inf")
    return model


def exemplars(each: int = 160) -> list[str]:
    """Made-up texts with one span each of every added kind that passes, and as many that fail its check."""
    rng = np.random.default_rng(17)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *a: a[rng.integers(len(a))]
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))

    def iban(off: int) -> str:
        body = pick(lambda: ("DE", digits(18)), lambda: ("GB", word(4).upper() + digits(14)), lambda: ("FR", digits(23)), lambda: ("ES", digits(20)), lambda: ("NL", word(4).upper() + digits(10)))()
        value = int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        whole = f"{body[0]}{(98 - value + off - 2) % 97 + 2:02d}{body[1]}"
        return pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    def mail(good: bool) -> str:
        local, host, top = word(rng.integers(3, 12)), word(rng.integers(3, 12)), word(rng.integers(2, 5))
        if good:
            return f"{local}{pick(' (at) ', '(at)', ' [at] ', '[AT]')}{host}{pick(' (dot) ', '(dot)', ' [dot] ', '[DOT]', '.')}{top}"
        return f"{local} {pick('(at)', '[at]')} {host}. {top.capitalize()}"

    def ident(good: bool) -> str:
        area = pick(f"{rng.integers(1, 666):03d}", f"{rng.integers(667, 900):03d}")
        if good:
            return f"{area}-{rng.integers(1, 100):02d}-{rng.integers(1, 10_000):04d}"
        return pick(f"{pick('000', '666', str(rng.integers(900, 1000)))}-{digits(2)}-{digits(4)}", f"{area}-00-{digits(4)}", f"{area}-{digits(2)}-0000")

    phone = lambda: pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(5)} {digits(2)}", f"0{digits(2)}/{digits(3)} {digits(4)}", f"{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")
    plain = lambda: pick("", f"{word(5)} {word(7)} ")
    said = {"iban": ("IBAN ", "account: ", "bank "), "mail": ("mail ", "contact: ", "write to "), "id": ("SSN ", "social security: ", "ID ")}
    out = []
    for i in range(each):
        for good in (True, False):
            for name, span in (("iban", iban(0 if good else int(rng.integers(1, 97)))), ("mail", mail(good)), ("id", ident(good))):
                out.append(f"{plain()}{pick('', *said[name])}{span}{pick('', '.', ', ' + word(4))}")
            out.append(f"{plain()}{pick('phone ', 'tel: ', 'mobile ', 'fax ', 'call ') if good else ''}{phone()}")
        number = pick(f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2030)}", f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{digits(2)} {digits(2)}")
        out.append(f"{plain()}{pick('', 'call ', 'phone ')}{number}")
    return out


def sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """``text`` of at most ``max_docs`` distinct texts, the first by hash, with a share for each added kind and one for the rest."""
    mix = F.xxhash64("text")
    likely = docs.select("text").where(F.col("text").rlike("[0-9@]|\\((?:at|AT)\\)|\\[(?:at|AT)\\]"))
    groups = F.array_compact(F.array(F.lit("any"), *[F.when(F.col("text").rlike(PROPOSALS[k]), F.lit(k)) for k in MORE]))
    rows = likely.select(mix.alias("h"), F.explode(groups).alias("g")).distinct()
    picked = sorted({r["h"] for r in cm.least_hashes(rows, max_docs)})
    chosen = docs.sparkSession.createDataFrame([(h,) for h in picked], "h long")
    return likely.withColumn("h", mix).join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).select("text")


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_spans: int = TRAIN_SPANS) -> Boosted | None:
    """Train on the proposals of a bounded sample of texts and on made-up ones."""
    made = docs.sparkSession.createDataFrame([(t,) for t in exemplars()], "text string")

    def rows_of(texts: DataFrame, bound: int) -> list:
        df = proposed(texts.withColumn("__id", F.lit(0)), "__id")
        own = lambda k: F.slice(F.filter(F.concat("base", "more"), lambda s: s["kind"] == k), 1, PER_TEXT)
        few = F.flatten(F.array(*[F.transform(own(k), lambda s, i: F.struct(i.alias("i"), s.alias("s"))) for k in range(len(KINDS))]))
        # A text's first span of each kind comes before any second one, so no kind or text fills the bound.
        each = df.select("__t", F.explode(few).alias("c")).select("__t", "c.i", "c.s")
        families = F.array(*[F.lit(FAMILY[k]) for k in KINDS])
        each = each.select("i", "s", features(F.col("__t"), F.col("s"), F.get(families, F.col("s.kind"))).alias("f"), F.xxhash64("__t", "s").alias("h"))
        good = (F.col("f.valid") == 1) & ((F.col("s.kind") != KINDS.index("phone_local")) | (F.col("f.hint") == 1))
        return each.orderBy("i", "h").limit(bound).select(F.col("s.kind").alias("kind"), good.cast("int").alias("y"), "f.*").collect()

    rows = rows_of(sample(docs, max_docs), max_spans) + rows_of(made, max_spans)
    table = np.array([[r["kind"], r["y"], *[r[f] for f in FEATURES]] for r in rows], dtype=np.int64)
    table = table[np.lexsort(table.T)]
    table = table[np.random.default_rng(5).permutation(len(table))]
    return boost(table[:, 2:].astype(float), table[:, 1].astype(float), kinds=table[:, 0])


def find(docs: DataFrame, model: Boosted | None, *keep: str) -> DataFrame:
    """``keep`` columns with ``base`` and ``found``: all spans sorted by kind, then start."""
    df = proposed(docs, *keep)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if model is None:
        added = none
    else:
        limits = F.array(*[F.lit(model.thresholds.get(i, float("inf"))) for i in range(len(KINDS))])
        scored = F.transform(described("more"), lambda d: F.struct(
            d["s"].alias("s"), (model.column(d["f"]) >= F.get(limits, d["s"]["kind"])).alias("ok")))
        added = F.when(F.size("more") > 0, F.transform(F.filter(scored, lambda d: d["ok"]), lambda d: d["s"])).otherwise(none)
    counts = [F.size(f"__s_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select(*keep, *counts, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    spans = find(docs, fit(docs), "doc_id")
    return spans.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[f"n_{k}" for k in BASE],
        F.sha2(sp.spelled(F.col("base"), KINDS), 256).alias("base_sha256"), sp.spelled(F.col("found"), KINDS).alias("spans"))

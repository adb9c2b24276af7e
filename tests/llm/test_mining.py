"""Whitening, collocations and toxicity against brute force, on driver data and awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutledger.llm import collocations, common as cm, toxicity, whitening
from tests.conftest import SF_DIR
from tests.llm.test_corpus import AWKWARD, frame


def brute_whitening(rows, components, weights):
    """Distinct vectors, exact sums, and up to sign the projections of each row."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    counts = Counter(map(tuple, x))
    w = np.array([1 if weights == "one" else n for n in counts.values()])
    fit = np.array(list(counts), dtype=object)
    n, total = int(w.sum()), (fit * w[:, None].astype(object)).sum(axis=0)
    far = lambda v: (np.array(v, dtype=object) * n - total)
    z = (far(fit) / n).astype(float)
    values, axes = np.linalg.eigh((z * w[:, None]).T @ z / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float((z * z * w[:, None]).sum() / n)
    return n, [int((far(v) ** 2).sum()) for v in x], (far(x) / n).astype(float) @ axes / np.sqrt(values), values / trace


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(2)
    vecs = [(i, [float(c) for c in rng.normal(0, [1, 2, 0.5, 3], 4)]) for i in range(150)]
    vecs += [(200 + i, vecs[3][1]) for i in range(300)] + [(None, vecs[5][1]), vecs[7], vecs[7]]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("-inf")] * 4), (904, []), (905, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in vecs + bad], "vec_id long, embedding array<double>, slices string, k1 int, x int").repartition(7)
    got = whitening.whiten(df, weights=weights).collect()
    n, deviation, projected, explained = brute_whitening(vecs, 4, weights)
    assert len(got) == 4 * len(vecs) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(by[vecs[7][0]]) == 12
    signs = {}
    for k, (i, _) in enumerate(vecs):
        for r in by[i]:
            c = r["component"] - 1
            signs.setdefault(c, np.sign(r["whitened"] * projected[k, c]))
            assert r["deviation"] == deviation[k] and abs(r["whitened"] - signs[c] * projected[k, c]) < 1e-9 and abs(r["explained"] - explained[c]) < 1e-12


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    huge = whitening.whiten(spark.createDataFrame([(i, [i * 1e14, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None} and huge[0]["identity_error"] < 1e-6


def brute_collocations(rows, top=2000, least=30):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    made = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            score, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            made[p] = (score, a, f[p[: k + 1]], f[(p[0], *p[k + 1 :])])
    longer = Counter()
    for p, (_, a, _, _) in made.items():
        for size in range(2, len(p) - 1):
            for i in range(1, len(p) - size + 1):
                q = (p[0], *p[i : i + size])
                longer[q] = max(longer[q], a)
    kept = [(p[0], -s, -a, " ".join(p[1:]).encode(), l, r) for p, (s, a, l, r) in made.items() if 100 * longer[p] < 80 * a or p not in longer]
    out, rank = [], Counter()
    for lang, s, a, phrase, l, r in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def test_collocations_of_documents(spark):
    docs = cm.table(spark, SF_DIR, "documents")
    assert mined(docs, least=4) == brute_collocations([(r["lang"], r["text"]) for r in docs.collect()], least=4) != []


def test_collocations_of_awkward_rows(spark):
    rng = random.Random(3)
    words = ["A", "b", "ä", "漢", "c-d", "\x1cx", "\x00"]
    made = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", None, "und"])) for i in range(200)]
    made += [(300, "hot pair of words " * 4000, "en")] * 2 + [(None, "hot pair", None), (7, "...", "zz")]
    rows = [(lang, text) for _, text, lang in AWKWARD + made]
    rows = [(lang, text) for _, text, lang in [(i, t, g) for i, t, g in AWKWARD + made]]
    want = brute_collocations(rows, top=20, least=5)
    df = frame(spark, AWKWARD + made).repartition(5)
    # Few slots make phrases share them; small blocks cut the long text between its words.
    assert mined(df, top=20, least=5, shards=3, slots=64, block_words=500) == want != []
    assert mined(frame(spark).limit(0)) == [] and mined(frame(spark).where("doc_id = 4")) == []


def test_phrases_are_spelled_until_a_shard_holds_them(spark, monkeypatch):
    text = "one two three four " * 20
    df = spark.range(0, 8, 1, 8).select(F.lit("en").alias("lang"), F.lit(text).alias("text"))  # a block of each row, two in a shard
    made, spell = [], collocations.spelled

    def seen(*given):
        out = spell(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(collocations, "spelled", seen)
    assert mined(df) == brute_collocations([("en", text)] * 8) != []
    assert 0 < sum(made) <= 2 * 16  # 16 phrases; all eight blocks would spell 128


def test_threshold_has_least_risk():
    toxic, free = np.array([2.0, 3.0, 4.0]), np.array([-1.0, 0.0, 0.5, 1.0, 3.5] * 4)
    assert 1.0 < toxicity.threshold(toxic, free, 0.2) < 2.0


def test_long_texts_in_parts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 9))) for _ in range(5000))
    model = toxicity.Model(np.random.default_rng(0).normal(0, 1, 1 << toxicity.BITS), -1.0, 0.2)
    whole = toxicity.scores(model, [text, None, "", "!!!", text[:3000], "x" * 9000])
    room, toxicity.SEGMENT = toxicity.SEGMENT, 1000
    try:
        assert np.allclose(whole, toxicity.scores(model, [text, None, "", "!!!", text[:3000], "x" * 9000]))
    finally:
        toxicity.SEGMENT = room
    assert whole[1] == whole[2] == whole[3]


def planted(spark, n=600):
    """Texts of made-up words, an eighth of them with two to four words of stems that no other text has."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8)))
    made, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(20, 300))]
        toxic = i % 8 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["zorg", "vrux"]) + word())
        made.append((i, " ".join(ws), "en"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    made += [made[8]] * 40 + [(5000, None, None), (5001, "", "en"), (None, made[0][1], "en"), (5002, "clean words here " * 40_000, "en")]
    labels += [(8, 0, 1), (None, 1, 1), (5003, 1, None)]
    return frame(spark, made).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), made


def test_toxicity_on_held_out_rows(spark):
    import zlib

    docs, labels, made = planted(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(made)
    found = {r["doc_id"]: r for r in got}
    for i in range(600):
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    for part in (True, False):
        rows = [i for i in range(600) if found[i]["held_out"] is part]
        caught = [found[i]["predicted"] for i in rows if i % 8 == 0]
        false = [found[i]["predicted"] for i in rows if i % 8]
        assert np.mean(caught) >= 0.9 and np.mean(false) <= 0.03
    assert found[5000]["score"] == found[5001]["score"] < 0.5 and found[5002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_without_examples(spark):
    docs, labels, _ = planted(spark, 40)
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, _ = planted(spark, 80)
    held = labels.where(toxicity.held_out(labels["doc_id"]))
    assert toxicity.fit(docs, held) == (None, 0.0)

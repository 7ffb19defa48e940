"""Containment, novelty and roots against brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import containment, novelty, roots


def plain(text):
    return re.sub("[^a-z0-9가-힣]+", " ", (text or "").lower()).strip()


def features(text, kind):
    if kind == "words":
        return {w for w in plain(text).split(" ") if len(w) > 1}
    packed = plain(text).replace(" ", "")
    return {packed[i : i + 5] for i in range(max(len(packed) - 4, 1))} - {""}


@pytest.mark.parametrize("kind", ["words", "char5"])
@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_containment_equals_brute_force(spark, kind, block_chars):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "go", "임상시험", "x", "Q1-2", "delta", "no"]) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(90, None), (91, ""), (92, "go"), (93, "éé")]
    items = [(f"i{i}", say(rng.randrange(1, 12))) for i in range(20)] + [("short", "Go"), ("none", None), ("blank", "--"), ("same", "alpha beta"), ("same", "alpha beta")]
    got = containment.contained(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i string, text string"), "d", "i", "text", kind, 0.5, block_chars)
    want = []
    for d, t in docs:
        for i, u in items:
            a, b = features(t, kind), features(u, kind)
            if b and len(a & b) >= 0.5 * len(b):
                want.append((d, i, len(a & b), len(b)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert containment.contained(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame([], "i string, text string"), "d", "i", "text", kind, 0.5).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_novelty_equals_brute_force(spark, block):
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.randrange(300), sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(5))})) for i in range(90)] + [(95, "b", None, ["a"]), (96, "alone", 5, ["a"])]
    spans = {"short": 10, "long": 80}
    got = {r["uid"]: (r["short"], r["long"]) for r in novelty.greatest_likeness(spark.createDataFrame(rows, "u int, k string, t int, w array<string>"), "u", "k", "t", "w", spans, block).collect()}
    for u, k, t, w in rows:
        if k is None or t is None:
            assert u not in got
            continue
        for at, span in zip(got[u], spans.values()):
            like = [len({*w} & {*v}) / max(len({*w} | {*v}), 1) for _, key, s, v in rows if key == k and s is not None and t - span <= s < t]
            assert at == (pytest.approx(max(like)) if like else None)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_common_subsequence_bounds_matching_blocks(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(table[j] + 1 if x == y else max(table[j + 1], row[j]))
        table = row
    assert roots.longest_common_subsequence(a, b) == table[-1]
    assert sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) <= table[-1]


def plain_rule(a, b, x, y, seconds):
    pa, pb = plain(a), plain(b)
    ga, gb = features(a, "char5"), features(b, "char5")
    ratio = lambda s, t: SequenceMatcher(None, s, t, autojunk=False).ratio() if s and t else 0.0
    jaccard = len(ga & gb) / len(ga | gb) if ga and gb else 0.0
    contained = len(ga & gb) / min(len(ga), len(gb)) if ga and gb else 0.0
    if ratio(pa, pb) >= 0.82 or jaccard >= 0.7 or contained >= 0.55:
        return roots.NEAR_COPY
    if 0 < len(pa) < 300 and len(pb) >= 500 and ratio(plain(x), plain(y)) >= 0.7 and seconds is not None and abs(seconds) <= 300:
        return roots.SHORT_EXCERPT
    return ""


def test_root_rule_equals_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["trial", "met", "goal", "stock", "fell", "after", "note", "임상"]) + str(rng.randrange(60)) for _ in range(n))
    rows, t = [], 0
    for e in range(12):
        base = say(rng.choice([5, 20, 120]))
        words = base.split()
        for k in range(6):
            changed = " ".join(w if rng.random() > k / 7 else say(1) for w in words)
            body = rng.choice([changed, base[: len(base) // 2], say(150), "", None, base])
            rows.append((f"e{e}", 10 * e + k, rng.choice(["Drug met its goal", "Drug met its goals", "Other news"]), base if k == 0 else body, rng.choice([t, t + 200, t + 900, None])))
    rows.append((None, 999, "x", "y", 0))
    df = spark.createDataFrame(rows, "event string, uid int, headline string, body string, t int")
    got = {(r["base"], r["candidate"]): r["reason"] for r in roots.root_sharing(df.where("uid % 10 = 0"), df).collect()}
    want = {}
    for e, u, h, b, s in rows:
        for f, v, i, c, z in rows:
            if e is not None and e == f and u % 10 == 0 and u != v:
                why = plain_rule(b, c, h, i, None if s is None or z is None else s - z)
                want |= {(u, v): why} if why else {}
    assert got == want and set(want.values()) == {roots.NEAR_COPY, roots.SHORT_EXCERPT}
    assert roots.root_sharing(df.limit(0), df).select(F.count("*")).first()[0] == 0

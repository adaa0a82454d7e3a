"""Spelling variants, the rule ensemble and hard negatives on small tables with every odd case, against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tierflow.llm import hard_negatives, quality, spelling

LONG = "abcdefghij" * 8
WORDS = ["banana", "bananas", "banane", "bananne", "cabana", "orange", "orànge", "oräng", "orangé", "straße", "strasse", "ÀÉÎÕÜÿ", "àÉÎÕÜÿ", "apples", "apple",
         "appless", "xx×÷yy", "xx×yy", LONG, LONG[:-1], LONG[:40] + "x" + LONG[41:], LONG + "j", "aaaaaa", "aaaaaaa", "aaaaab"]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    rng = np.random.default_rng(5)
    out = [(i, " ".join(w.upper() if rng.random() < .2 and w.isascii() else w for w in rng.choice(WORDS, 60, p=np.arange(1, len(WORDS) + 1) / 325)))
           for i in range(40)]
    return out + [(None, "banana orange BANANA"), (7, None), (8, ""), (9, "12 34 !!"), (10, "banana-bananas_orange\nбанан 한국 apples"), (3, out[3][1]),
                  (11, ("orange " * 3000) + LONG * 40), (12, "x" * 9000), (-5, "Banana\0orange퟿apples")]


def table(spark, rows):
    odd = ["word", "n", "near", "part", "segment", "bits", "block", "score", "rules", "s", "j", "label"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in odd})


def variants(rows, chars, count, times, one_in):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % one_in == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= chars and k >= count}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near, form = {w: [v for v in n if apart(w, v)] for w in n}, {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= times * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("chars, count, times, one_in, filter_bytes", [(6, 5, 5, 199, 1 << 20), (3, 1, 2, 3, 1 << 20), (1, 2, 1.5, 5, 24)])
def test_spelling_variants(spark, texts, chars, count, times, one_in, filter_bytes):
    got = spelling.spelling_variants(table(spark, texts), chars, count, times, one_in, filter_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    want = variants(texts, chars, count, times, one_in)
    assert len(rows) == len(want) and set(rows) == want and any(r[1] for r in rows)


def test_slip():
    assert spelling.slip(1, "banana", 1) == "banana"[:(k := zlib.crc32(b"1:banana") % 6)] + "banana"[k + 1:]


def test_bloom_filters_hold_their_words(spark, texts):
    words = spark.createDataFrame([(w, 1) for w in WORDS if re.fullmatch("[a-zÀ-ÿ]+", w)], "word string, n bigint")
    lengths = sorted({min(len(w), spelling.LONGEST) for w in WORDS})
    shards = {k: (i * 4, 4) for i, k in enumerate(lengths)}
    bloom = spelling._filter(words, shards, 4 * len(lengths))
    for at, m in spelling._letters([r["word"] for r in words.collect()]):
        block, bits = spelling._place(spelling._hash(m), m.shape[1], shards)
        assert (bloom[block] & bits == bits).all()


def test_no_words(spark, texts):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, "12 ab"), (2, None)])).count() == 0
    alone = spelling.spelling_variants(table(spark, [(1, "lonely " * 6)])).collect()
    assert [tuple(r) for r in alone] == [("lonely", None, "lonely", 6, 0, None)]


# quality

def statistics(text):
    left = {k: len(regex.sub(p, "", text)) for k, (p, _) in quality.CLASSES.items()}
    found = {k: sum(1 for _ in regex.finditer(p, text)) for k, (p, _) in quality.MATCHES.items()}
    of = {"chars": max(1, len(text)), "words": max(1, len(regex.findall(r"[^ \t\n\x0B\f\r]+", text))), "letters": max(1, left["letter_share"])}
    return {"log_chars": math.log2(len(text) + 1), "word_chars": len(text) / of["words"],
            **{k: left[k] / of[per] for k, (_, per) in quality.CLASSES.items()}, **{k: found[k] / of[per] for k, (_, per) in quality.MATCHES.items()}}


def labelled(n):
    rng = np.random.default_rng(9)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("etaonris"), rng.integers(2, 9))) for _ in range(rng.integers(5, 60))]
        good = bool(rng.random() < .6)
        text = " ".join(w + ("." if k % 7 == 6 else "") for k, w in enumerate(words)) if good else " ".join(w + "&&&" for w in words)
        out.append((i, text, int(good)))
    return out


def test_quality(spark, texts):
    rows = labelled(300)
    odd = [(i and i + 1000, t) for i, t in texts]
    docs = table(spark, [(i, t) for i, t, _ in rows] + odd)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (1005, None), (1006, 7), (400, 0), (1, rows[1][2])], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.judged(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and 0 < len(model.rules) <= quality.TREES * 14
    known = defaultdict(set)
    for i, t in [(i, t) for i, t, _ in rows] + odd:
        s = statistics(t or "")
        fired = [k for k, r in enumerate(model.rules) if all(low < s[name] <= high for name, low, high in r.bounds)]
        known[i].add((tuple(fired), round(1 / (1 + math.exp(-model.bias - sum(model.rules[k].weight for k in fired))), 9)))
    truth = {i: q for i, _, q in rows}
    wrong = 0
    for r in got:
        assert (tuple(r["rules"]), round(r["score"], 9)) in known[r["doc_id"]] and r["predicted"] == (r["score"] >= .3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        wrong += r["held_out"] and truth.get(r["doc_id"], r["predicted"]) != r["predicted"]
    assert wrong <= 2


def test_quality_learns_nothing_from_held_out_labels(spark, texts):
    rows = labelled(120)
    docs = table(spark, [(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int"))
    two = quality.train(docs, spark.createDataFrame([(i, 1 - q if held(i) else q) for i, _, q in rows], "doc_id bigint, quality int"))
    assert [r.bounds for r in one.rules] == [r.bounds for r in two.rules] and np.allclose([r.weight for r in one.rules], [r.weight for r in two.rules])


@pytest.mark.parametrize("labels, score", [([], .5), ([(1, 1), (2, 1)], 1), ([(1, 0), (2, 0)], 0)])
def test_quality_of_few_labels(spark, texts, labels, score):
    of = spark.createDataFrame(labels, "doc_id bigint, quality int")
    docs = table(spark, texts)
    # these ids are in the learning rows
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _ in labels)
    docs = docs.unionByName(table(spark, [(1, "some text"), (2, None)]))
    assert all(abs(r["score"] - score) < 1e-9 for r in quality.score(docs, of).collect())
    assert quality.score(table(spark, []), of).count() == 0


def test_rules_of_a_printed_forest():
    printed = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    inf = math.inf
    assert [r.bounds for r in quality.rules_of(printed, ["a", "b"])] == [
        (("a", -inf, .5),), (("a", -inf, .5), ("b", -inf, 2.0)), (("a", -inf, .5), ("b", 2.0, inf)), (("a", .5, inf),)]


# hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int"


def vectors():
    rng = np.random.default_rng(11)
    out = [(i, rng.normal(size=6).round(2).tolist(), int(rng.integers(0, 4))) for i in range(90)]
    same = [.5, .25, -1.0, 0.0, 0.0, .125]
    out += [(100 + i, same, i % 3) for i in range(25)]
    inf = math.inf
    return out + [(None, same, 1), (201, None, 1), (202, same, None), (203, [1.0, None], 2), (204, [math.nan], 2), (205, [inf], 2), (206, [-inf, 1.0], 2),
                  (207, [], 1), (208, [3.0], 1), (209, [1.0] * 9, 2), (210, [0.0] * 6, 0), (20, out[20][1], out[20][2]), (30, same, 3), (30, same, 2), (-50, same, 2)]


def mined(rows, n_positives, n_negatives, low, high):
    by = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        by[i] = min(by.get(i, (y, v)), (y, v))
    q = {i: [math.floor(256 * x) for x in v] for i, (_, v) in by.items()}
    out = set()
    for a in by:
        if a % 10:
            continue
        order = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in by if b != a)
        for s, p in [(s, b) for s, b in order if by[b][0] == by[a][0]][:n_positives]:
            found = [(t, b) for t, b in order if by[b][0] != by[a][0] and low * -s <= 100 * -t <= high * -s]
            out |= {(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(found[:n_negatives])}
    return out


def vector_table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit(c) for c in ("p", "q", "v", "r", "id", "score", "good", "anchor_id", "fine")})


@pytest.mark.parametrize("how", [(5, 3, (50, 95), 1 << 15, 1 << 13), (2, 4, (10, 100), 20, 3), (50, 50, (0, 100), 33, 100)])
def test_hard_negatives(spark, texts, how):
    rows = vectors()
    got = [tuple(r) for r in hard_negatives.hard_negatives(vector_table(spark, rows), F.col("vec_id") % 10 == 0, *how).collect()]
    want = mined(rows, how[0], how[1], *how[2])
    assert len(got) == len(want) > 5 and set(got) == want


def test_hard_negatives_of_large_numbers(spark, texts):
    rows = [(i, [x * 1e6 for x in v], y) for i, v, y in vectors() if i is not None and i < 60 and v]
    got = [tuple(r) for r in hard_negatives.hard_negatives(vector_table(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    assert set(got) == mined(rows, 5, 3, 50, 95) and len(got) > 5
    huge = vector_table(spark, [(0, [1e30], 1), (10, [2e30], 1), (3, [1.5e30], 2), (4, [1e-3], 2)])
    assert all(max(r[4], r[5]) <= hard_negatives._TOP for r in hard_negatives.hard_negatives(huge, F.col("vec_id") % 10 == 0).collect())


def test_no_anchor_and_no_rows(spark, texts):
    assert hard_negatives.hard_negatives(vector_table(spark, vectors()), F.lit(False)).count() == 0
    assert hard_negatives.hard_negatives(vector_table(spark, []), F.lit(True)).count() == 0


def test_packed_keys_sort_by_anchor_then_descending_score_then_id():
    rng = np.random.default_rng(2)
    rows = [(*(int(x) for x in rng.integers(-3, 4, 3)), bool(rng.integers(0, 2))) for _ in range(200)]
    rows += [(0, hard_negatives._TOP, 1, True), (0, -hard_negatives._TOP, 1, False)]
    assert sorted(hard_negatives.packed(*r) for r in rows) == [hard_negatives.packed(*r) for r in sorted(rows, key=lambda r: (r[0], -r[1], r[3], r[2]))]
    assert all(hard_negatives.unpacked(hard_negatives.packed(*r)) == r for r in rows)

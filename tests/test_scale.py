"""Skew-safe helpers and the operators on them, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tierflow.operators import dataset as D, feedback as B, retrieval as I
from tierflow.operators.scale import dimension, position_bucket, running, shuffled_rank, top_per_key, uniform_hash

T0 = dt.datetime(2024, 1, 1)


def test_running_with_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < .6 else f"k{rng.randrange(5)}", i, rng.randrange(-3, 4), rng.choice([None, "a", "b"]))
            for i in range(600)]
    d = spark.createDataFrame(data, "k string, i long, v long, p string")
    got = running(d, ["k"], ["i"], position_bucket(F.col("i"), 37), sums={"s": F.col("v")}, previous={"q": F.col("p")},
                  totals={"t": F.col("v")}, mins={"m": F.col("v")})
    state, total = defaultdict(lambda: [0, None, 99]), defaultdict(int)
    for k, _, v, _ in data:
        total[k] += v
    want = {}
    for k, i, v, p in data:
        s = state[k]
        before = s[1]
        s[0], s[2] = s[0] + v, min(s[2], v)
        s[1] = p if p is not None else s[1]
        want[i] = (s[0], before, total[k], s[2])
    assert {r.i: (r.s, r.q, r.t, r.m) for r in got.collect()} == want


def test_seeded_take_is_exact(spark):
    d = spark.range(1000).withColumn("label", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 7, "b").otherwise("c"))
    h = {r.id: r.h for r in d.select("id", uniform_hash(F.col("id"), 42).alias("h")).collect()}
    by = defaultdict(list)
    for r in d.collect():
        by[r.label].append(r.id)
    want = set()
    for ids in by.values():
        want |= set(sorted(ids, key=lambda i: (h[i], i))[:int(len(ids) * .8)])
    for buckets in (4, 4096):
        got = D.seeded_take(d, ["label"], "id", 42, lambda t, _: F.floor(t * .8), buckets)
        assert got.count() == 1000 and {r.id for r in got.where("taken").collect()} == want
    split = D.stratified_split(d)
    assert split.count() == 1000 and {r.id for r in split.where("part = 'train'").collect()} == want
    bal = D.balanced_sample(d.withColumn("target", (F.col("label") == "a").cast("int")))
    assert {r["target"]: r["count"] for r in bal.groupBy("target").count().collect()} == {0: 334, 1: 334}
    few = D.balanced_sample(d.withColumn("target", (F.col("label") == "b").cast("int")))
    assert few.count() == 0


def test_ranks_and_tops(spark):
    d = spark.range(500).withColumn("k", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    r = shuffled_rank(d, ["k"], "id", 7, buckets=16)
    assert sorted(x["rank"] for x in r.where("k = 'x'").collect()) == list(range(1, 251))
    top = top_per_key(d, ["k"], [F.col("id").desc()], 3)
    assert sorted(x.id for x in top.collect()) == [494, 495, 496, 497, 498, 499]


def test_dedup_keeps_first(spark):
    d = spark.createDataFrame([(3, "a", "z"), (1, "a", "x"), (2, "b", "y")] + [(i, "a", "w") for i in range(10, 90)],
                              "id long, text string, tag string")
    assert sorted(tuple(r) for r in D.dedup_exact(d).collect()) == [(1, "a", "x"), (2, "b", "y")]


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.beta(2, 5, 777), 3)
    d = spark.createDataFrame([(float(x),) for x in v], "s double")
    r = D.exact_quantiles(d, "s", [.05, .2, .5, .9]).first()
    assert np.allclose([r.q0, r.q1, r.q2, r.q3], np.quantile(v, [.05, .2, .5, .9]))
    assert abs(D.calibrate_bounds(d, "s", approximate=True).first().median - np.quantile(v, .5)) < .01


def test_match_votes_against_stack(spark):
    rng = random.Random(5)
    req, rep, events = [], [], []
    for i in range(400):
        agent, t = rng.choice(["hot", "hot", "a", "b"]), T0 + dt.timedelta(seconds=rng.randrange(20000))
        if rng.random() < .5:
            req.append((i, agent, t, "heavy"))
            events.append((agent, t, 0, i))
        else:
            word = rng.choice(["yes", "no", "later"])
            rep.append((i, agent, t, word))
            if word != "later":
                events.append((agent, t, 1, i))
    open_, want = defaultdict(list), {}
    for agent, t, kind, i in sorted(events):
        if kind == 0:
            open_[agent].append((t, i))
        elif open_[agent] and t < open_[agent][-1][0] + dt.timedelta(minutes=5):
            want[i] = open_[agent].pop()[1]  # expired requests simply stay below
    a = spark.createDataFrame(req, "request_id long, agent_id string, asked_at timestamp_ntz, predicted_tier string")
    b = spark.createDataFrame(rep, "reply_id long, agent_id string, replied_at timestamp_ntz, reply_text string")
    got = B.apply_votes(B.match_votes(b, a, slice_seconds=600)).collect()
    assert {r.reply_id: r.request_id for r in got} == want and len(got) == len(want)


def test_history_bias_across_chunks(spark):
    rng = random.Random(9)
    tiers = ["trivial", "light", "moderate", "heavy"]
    data = [(i, "hot" if i % 4 else "b", T0 + dt.timedelta(minutes=7 * i), rng.choice(tiers), rng.choice(tiers + [None]),
             rng.choice([None, .2, .9])) for i in range(500)]
    d = spark.createDataFrame(data, "interaction_id long, agent_id string, ts timestamp_ntz, predicted_tier string, "
                                    "actual_tier string, adequacy double")
    seen, want = defaultdict(list), {}
    for i, a, _, p, t, q in data:
        last = seen[a][-50:]
        up = sum(1 for x in last if x[1] and tiers.index(x[1]) > tiers.index(x[0]))
        down = sum(1 for x in last if x[1] and tiers.index(x[1]) < tiers.index(x[0]))
        low = sum(1 for x in last if (x[2] if x[2] is not None else .5) < .6)
        raw = .02 * up - .02 * down + (.05 if last and low / len(last) > .3 else 0)
        want[i] = 0.0 if len(last) < 5 or up + down < 3 else max(-.1, min(.1, raw))
        seen[a].append((p, t, q))
    got = {r.interaction_id: r.bias for r in B.history_bias(d, chunk=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_retrieve_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["kafka", "kafkaesque", "redis", "redistribute", "docker", "dock", "schema", "scheme", "data", "database", "abc", "ab"]
    entries = [(i, i, rng.sample(vocab, 4), rng.sample(["data", "code", "infra"], 1)) for i in range(60)]
    queries = [(i, rng.sample(vocab, 3) + (["kafka"] if i % 2 else [])) for i in range(40)]
    e = spark.createDataFrame(entries, "entry_id long, created long, keywords array<string>, tags array<string>")
    q = spark.createDataFrame(queries, "query_id long, keywords array<string>")
    want = set()
    for qid, kws in queries:
        scored = [(-sum(any(k in t or t in k for t in set(ks + tg)) for k in kws), c, i) for i, c, ks, tg in entries if 59 - c < 50]
        want |= {(qid, n, -s, i) for n, (s, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:5], 1)}
    got = {(r.query_id, r["rank"], r.score, r.entry_id) for r in I.retrieve(q, e, 5, now=59, ttl=50).collect()}
    assert got == want


def test_label_fusion(spark):
    d = spark.createDataFrame([
        (1, "gold", "heavy", 1.0, 2), (1, "silver", "light", 1.0, 0), (2, "silver", "light", 1.0, 0), (2, "bronze", "heavy", 1.0, 1),
        (3, "silver", "light", 0.0, 0)], "id long, source string, tier string, weight double, seq long")
    got = {r.id: (r.tier, round(r.confidence, 4)) for r in B.combine_labels(d).collect()}
    assert got == {1: ("heavy", 1.0), 2: ("heavy", .625), 3: ("light", 0.0)}


def test_dimension_literals(spark):
    d = dimension(spark, ["a", "b", "c", "d"], [("it's\n\\", 1, 2.5, None), ("x", 2, 0.0, True)])
    assert [tuple(r) for r in d.collect()] == [("it's\n\\", 1, 2.5, None), ("x", 2, 0.0, True)]

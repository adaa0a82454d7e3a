"""Vote fatigue against a plain loop over every agent."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators import asks as K
from tierflow.operators.scale import unit_hash

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "interaction_id long, agent_id string, ts timestamp_ntz, predicted_tier string, confidence double, note string"
TIERS = ["trivial", "light", "moderate", "heavy", "intensive", "extreme", None]


def loop(rows, u, base=0.10):
    asks, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        n = asks.get(r[1], 0)
        rate = max(0.02, base * math.exp(-n / 50)) * (2 if r[3] in ("moderate", "heavy", "intensive") else 1)
        asked = r[3] not in ("trivial", "extreme") and ((r[4] is not None and r[4] < 0.5) or u[r[0]] < min(0.5, rate))
        out[r[0]] = (n, asked)
        asks[r[1]] = n + asked
    return out


@pytest.mark.parametrize("unsure, base", [(0.02, 0.10), (0.5, 0.10), (0.0, 0.9)])
def test_every_agent_as_a_plain_loop(spark, unsure, base):
    """One agent holds most rows, nearly all of them in one hour; times tie."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < .7 else rng.choice(["a", "b", None]), None if rng.random() < .01 else T0 + dt.timedelta(seconds=rng.randrange(3000)),
             rng.choice(TIERS), None if rng.random() < .05 else (0.3 if rng.random() < unsure else 0.9), "x") for i in range(6000)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    u = {r.interaction_id: r.u for r in d.select("interaction_id", unit_hash(F.col("interaction_id"), 42).alias("u")).collect()}
    got = K.with_asks(d, base=base)
    want = loop(rows, u, base)
    assert {r.interaction_id: (r.prior_asks, r.asked) for r in got.collect()} == want
    assert sum(a for _, a in want.values()) > 80
    assert {r.interaction_id for r in K.sample_for_votes(d, base=base).collect()} == {i for i, (_, a) in want.items() if a}


def test_runs_compose():
    rng = random.Random(5)
    levels = len(K.falling_rates())
    assert levels == 82
    import numpy as np
    p = np.array([rng.choice([0, 0, 3, 20, 60, 81, levels]) for _ in range(400)])
    for start in (0, 7, 81, 82, 500):
        n = start
        for x in p:
            n += int(x >= levels or n < x)
        cut = start
        for part in np.split(p, [50, 50, 51, 300]):
            assert start + 0 <= cut
            asked = K.run_decisions(part, cut, levels)
            cut = K.apply_function(K.run_function(part, levels), cut) if len(part) else cut
        assert cut == n and K.apply_function(K.run_function(p, levels), start) == n
        assert start + int(K.run_decisions(p, start, levels).sum()) == n


def test_hot_agent_lies_in_many_runs_and_empty_tables_work(spark):
    rows = [(i, "hot", T0, "light", 0.9, "x") for i in range(2000)]
    d = spark.createDataFrame(rows, SCHEMA)
    runs = d.repartitionByRange(4, "agent_id", "ts", "interaction_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(runs) == 4 and max(r["count"] for r in runs) < 1000
    assert K.with_asks(d.limit(0)).count() == 0
    twice = K.with_asks(K.with_asks(d))
    assert twice.columns == d.columns + ["prior_asks", "asked"] and twice.count() == 2000

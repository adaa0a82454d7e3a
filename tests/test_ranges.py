"""Ordered work on a log of which one agent and one hour hold most rows."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tierflow.operators import feedback as B
from tierflow.operators.scale import RANGE, in_ranges

T0 = dt.datetime(2024, 1, 1)
TIERS = ["trivial", "light", "moderate", "heavy"]


def log(spark, n=1500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        at = rng.randrange(3_600_000) if rng.random() < .5 else rng.randrange(90 * 86_400_000)
        rows.append((i, "hot" if rng.random() < .6 else f"a{rng.randrange(4)}", T0 + dt.timedelta(milliseconds=at), rng.choice(TIERS),
                     rng.choice(TIERS + [None]), rng.choice([None, .2, .9]), rng.choice(["m1", "m2"]), "done", rng.choice([True, False, None])))
    return spark.createDataFrame(rows, "interaction_id long, agent_id string, ts timestamp_ntz, predicted_tier string, actual_tier string, "
                                       "adequacy double, routed_model string, response_text string, agrees boolean")


def test_ranges_are_even_and_follow_the_order(spark):
    d = log(spark)
    for keys in ([], ["agent_id"]):
        rows = in_ranges(d, keys, ["ts", "interaction_id"], 12).collect()
        sizes = Counter(r[RANGE] for r in rows)
        assert sum(sizes.values()) == 1500 and len(sizes) == 12 and max(sizes.values()) < 2 * 1500 / 12
        at = [r[RANGE] for r in sorted(rows, key=lambda r: (*[r[k] for k in keys], r.ts, r.interaction_id))]
        assert at == sorted(at)
    assert in_ranges(d.limit(0), ["agent_id"], ["ts", "interaction_id"]).count() == 0


def test_ranges_give_what_slices_give(spark):
    d = log(spark)

    def same(make):
        ranges, slices = make(None), make(600)
        assert ranges.columns == slices.columns
        got = sorted(map(str, ranges.collect()))
        assert got == sorted(map(str, slices.collect())) and len(got) == 1500

    same(lambda s: B.calibration(d, F.col("agrees"), ~F.col("agrees"), slice_seconds=s))
    same(lambda s: B.history_bias(d, chunk=64, slice_seconds=s))
    same(lambda s: B.session_turns_log(d, slice_seconds=s))


def test_votes_in_ranges(spark):
    d = log(spark)
    asked = d.where("agrees").select(F.col("interaction_id").alias("request_id"), "agent_id", F.col("ts").alias("asked_at"), "predicted_tier")
    replied = d.where("not agrees").select(F.col("interaction_id").alias("reply_id"), "agent_id", F.col("ts").alias("replied_at"),
                                           F.lit("yes").alias("reply_text"))
    got = sorted(map(tuple, B.match_votes(replied, asked).collect()), key=str)
    assert got == sorted(map(tuple, B.match_votes(replied, asked, slice_seconds=600).collect()), key=str) and len(got) > 50

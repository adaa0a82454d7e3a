"""Votes paired inside ranges and across them, each reply read once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tierflow.operators import feedback as B

T0 = dt.datetime(2024, 1, 1)
ASKED = "request_id long, agent_id string, asked_at timestamp_ntz, predicted_tier string"
SAID = "reply_id long, agent_id string, replied_at timestamp_ntz, reply_text string"


def loop(requests, replies):
    """A stack per agent; rows without agent or time take no part."""
    events = sorted((r[2], kind, r[0], r[1], r[3]) for kind, rows in enumerate((requests, replies)) for r in rows if r[1] and r[2])
    opened, out = {}, []
    for t, kind, i, agent, text in events:
        mine = opened.setdefault(agent, [])
        if kind == 0:
            mine.append((t, i))
        elif text != "later" and mine and t < mine[-1][0] + dt.timedelta(seconds=300):
            out.append((i, mine.pop()[1]))
    return sorted(out)


def paired(spark, requests, replies, **options):
    got = B.match_votes(spark.createDataFrame(replies, SAID), spark.createDataFrame(requests, ASKED), **options).collect()
    return sorted((r.reply_id, r.request_id) for r in got)


def test_pairs_that_span_many_ranges(spark):
    rng = random.Random(4)
    at = lambda lo, hi: T0 + dt.timedelta(milliseconds=rng.randrange(lo * 1000, hi * 1000))
    agent = lambda: "hot" if rng.random() < .8 else rng.choice(["a", "b", None])
    text = lambda: rng.choice(["yes", "no", "wrong heavy", "later"])
    # requests first, replies after them, all young enough: every pair lies across the ranges
    requests = [(i, agent(), at(0, 140), "light") for i in range(200)]
    replies = [(i, agent(), at(140, 280), text()) for i in range(260)]
    assert paired(spark, requests, replies) == loop(requests, replies) and len(loop(requests, replies)) > 120
    # mixed, some too old, some without a time, one time shared by many
    when = lambda: rng.choice([at(0, 900), at(0, 900), T0 + dt.timedelta(seconds=300 * rng.randrange(4)), None if rng.random() < .1 else T0])
    requests, replies = [(i, agent(), when(), "light") for i in range(300)], [(i, agent(), when(), text()) for i in range(300)]
    want = loop(requests, replies)
    assert paired(spark, requests, replies) == want == paired(spark, requests, replies, slice_seconds=60) and len(want) > 60


def test_exactly_five_minutes_is_too_old(spark):
    requests = [(1, "a", T0, "light"), (2, "b", T0, "light")]
    replies = [(1, "a", T0 + dt.timedelta(seconds=300), "yes"), (2, "b", T0 + dt.timedelta(seconds=299), "yes")]
    assert paired(spark, requests, replies) == [(2, 2)]
    assert paired(spark, requests, []) == paired(spark, [], replies) == []


def test_a_reply_is_read_once(spark, monkeypatch):
    """Reading a reply is the costly part of a row; cutting the ranges must not repeat it."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def vote(text):
        if text is not None:
            read.add(1)
        return text == "yes"

    monkeypatch.setattr(B.T, "parse_vote_reply", lambda c: (vote(c), F.lit(None).cast("string")))
    requests = [(i, f"a{i % 3}", T0 + dt.timedelta(seconds=60 * i), "light") for i in range(90)]
    replies = [(i, a, t + dt.timedelta(seconds=30), "yes") for i, a, t, _ in requests]
    assert len(paired(spark, requests, replies)) == 90
    assert read.value == 90

"""Votes paired in a stream, against a plain loop and against the batch form."""

import datetime as dt
import random

import pytest

from tierflow.operators.feedback import match_votes
from tierflow.streaming import streams as Z

T0 = dt.datetime(2024, 1, 1)
ASKED = "request_id long, agent_id string, asked_at timestamp_ntz, predicted_tier string"
SAID = "reply_id long, agent_id string, replied_at timestamp_ntz, reply_text string"


def loop(requests, replies):
    """Each reply takes the newest open request of its agent that is under five minutes old."""
    events = sorted([(r[2], 0, r[0], r) for r in requests] + [(r[2], 1, r[0], r) for r in replies if r[3] != "later"], key=lambda e: e[:3])
    opened, out = {}, set()
    for t, kind, i, r in events:
        mine = opened.setdefault(r[1], [])
        if kind == 0:
            mine.append(r)
        elif mine and t < mine[-1][2] + dt.timedelta(seconds=300):
            out.add((i, mine.pop()[0]))
    return out


@pytest.fixture(scope="module")
def votes():
    rng = random.Random(11)
    agent = lambda: "hot" if rng.random() < .6 else rng.choice(["a", "b"])
    requests = [(i, agent(), T0 + dt.timedelta(seconds=rng.randrange(9000)), "light") for i in range(250)]
    replies = [(i, agent(), T0 + dt.timedelta(seconds=rng.randrange(9000)), rng.choice(["yes", "no", "wrong heavy", "later"])) for i in range(220)]
    return requests, replies


def test_five_batches_out_of_order_give_the_batch_result(spark, votes, tmp_path):
    requests, replies = votes
    rng = random.Random(2)
    events = Z.vote_events(spark.createDataFrame(replies, SAID), spark.createDataFrame(requests, ASKED)).collect()
    arrival = sorted(((e.t + dt.timedelta(seconds=rng.randrange(590)), i) for i, e in enumerate(events)))
    m = Z.VoteMatcher(str(tmp_path / "state"), str(tmp_path / "out"))
    cut = len(arrival) // 5 + 1
    for n in range(5):
        part = [events[i] for _, i in arrival[n * cut:(n + 1) * cut]]
        batch = spark.createDataFrame(part, Z.VOTE_EVENT)
        m.step(batch, n)
        if n == 2:  # a micro-batch repeated after a failure
            m.step(batch, n)
    m.finish(spark)
    got = [(r.reply_id, r.request_id) for r in m.matched(spark).collect()]
    assert len(got) == len(set(got)) and set(got) == loop(requests, replies)
    whole = match_votes(spark.createDataFrame(replies, SAID), spark.createDataFrame(requests, ASKED))
    assert set(got) == {(r.reply_id, r.request_id) for r in whole.collect()}


def test_late_rows_are_dropped_and_state_is_bounded(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    m = Z.VoteMatcher(str(tmp_path / "state"), str(tmp_path / "out"))
    rows = lambda *r: spark.createDataFrame(list(r), Z.VOTE_EVENT)
    m.step(rows(("a", at(0), 0, 1, "light", None), ("a", None, 0, 9, "light", None)), 0)  # no reply so far: nothing is decided
    m.step(rows(("a", at(100), 1, 1, None, "yes"), ("a", at(5000), 0, 2, "heavy", None), ("a", at(5000), 1, 2, None, "no")), 1)
    assert [(r.reply_id, r.request_id) for r in m.matched(spark).collect()] == [(1, 1)]
    m.step(rows(("a", at(50), 0, 3, "light", None), ("a", at(60), 1, 3, None, "yes")), 2)  # older than the watermark
    kept = spark.read.schema(Z.VOTE_EVENT).parquet(f"{m.state}/events0").collect()
    assert {(r.kind, r.id) for r in kept} == {(0, 2), (1, 2)}
    m.finish(spark)
    assert {(r.reply_id, r.request_id, r.agreed) for r in m.matched(spark).collect()} == {(1, 1, True), (2, 2, False)}

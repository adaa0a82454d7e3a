"""Conversation steps: invariants and a plain-Python model of the capping and clean-up."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators import convo as C

SCHEMA = "session_id long, pos long, role string, text string, tool_calls array<struct<id:string>>, tool_call_id string"


def talk(seed, n, sid):
    rng, out, last = random.Random(seed), [], None
    for p in range(n):
        role = rng.choices(["user", "assistant", "tool", "system"], [3, 4, 2, .3])[0]
        calls = [(f"c{p}",)] if role == "assistant" and rng.random() < .5 else None
        cid = rng.choice([last, "missing", None]) if role == "tool" else None
        last = calls[0][0] if calls else last
        text = rng.choice(["", " \n", "First point. Second point! Third?", "The final decision: go. More text follows here. " * 4,
                           "plain words " * 30 + ". And then more."])
        out.append((sid, p, role, text, calls, cid))
    return out


def capped(ms):
    n = len(ms)
    if n <= 60:
        return [m[1] for m in ms]
    keep = {i for i, m in enumerate(ms) if m[2] in ("system", "user") or i >= n - 30}
    drop, i = set(), 0
    while i < n:
        if ms[i][2] == "assistant" and ms[i][4]:
            j = i + 1
            while j < n and ms[j][2] == "tool":
                j += 1
            if not any(k in keep for k in range(i, j)):
                drop |= set(range(i, j))
            i = j
        else:
            if ms[i][2] == "assistant" and i not in keep:
                drop.add(i)
            i += 1
    return [m[1] for i, m in enumerate(ms) if i not in drop]


def sane(ms):
    if len(ms) <= 1:
        return [(m[2], m[3]) for m in ms]
    merged = []
    for m in ms:
        if m[2] == "system":
            continue
        if merged and merged[-1]["role"] == m[2]:
            merged[-1]["text"] += "\n---\n" + m[3]
            merged[-1]["cid"] = merged[-1]["cid"] or m[5]
        else:
            merged.append({"role": m[2], "text": m[3], "calls": m[4], "cid": m[5]})
    users = [i for i, m in enumerate(merged) if m["role"] == "user"]
    rows = [{"role": "system", "text": m[3], "calls": None, "cid": None} for m in ms if m[2] == "system"]
    rows += merged[users[0]:] if users else merged
    ids = {c[0] for m in rows if m["calls"] for c in m["calls"]}
    kept = []
    for m in rows:
        anchor = m["role"] == "assistant" and m["calls"]
        if not m["text"].strip() and not anchor:
            continue
        if m["role"] == "tool":
            if m["cid"] and m["cid"] not in ids or not kept or kept[-1]["role"] != "assistant":
                continue
        kept.append(m)
    while kept and kept[0]["role"] not in ("system", "user"):
        kept.pop(0)
    if not any(m["role"] == "user" for m in kept):
        at = next((i for i, m in enumerate(kept) if m["role"] != "system"), len(kept))
        kept.insert(at, {"role": "user", "text": "[Continuing conversation — please respond]"})
    return [(m["role"], m["text"]) for m in kept]


@pytest.fixture(scope="module")
def sessions():
    return {s: talk(s, n, s) for s, n in enumerate([1, 2, 5, 20, 61, 90, 130, 40, 75])}


@pytest.fixture(scope="module")
def frame(spark, sessions):
    return spark.createDataFrame([m for ms in sessions.values() for m in ms], SCHEMA).cache()


def test_cap(frame, sessions):
    got = {}
    for r in C.cap_messages(frame).orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append(r.pos)
    assert got == {s: capped(ms) for s, ms in sessions.items()}


def test_sanitise(frame, sessions):
    got = {}
    for r in C.sanitise(frame).orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append((r.role, r.text))
    assert got == {s: sane(ms) for s, ms in sessions.items()}


def test_compaction_invariants(spark):
    rows = []
    for s in range(3):
        for p in range(50):
            role = "system" if p == 0 else ["user", "assistant"][p % 2]
            rows.append((s, p, role, f"Point {p} is made. " * 80, None, None))
    d = spark.createDataFrame(rows, SCHEMA)
    m, e = C.compact(d, "glm-4.7")
    m = m.cache()
    live = m.where(~F.col("dropped"))
    assert live.where("role in ('system','user')").count() == d.where("role in ('system','user')").count()
    assert live.where("pos >= 47").count() == 9
    s = C.compaction_summary(m, e).collect()
    assert all(r.compressed_tokens < r.original_tokens and r.q8 + r.q4 + r.q2 + r.q1 == 50 for r in s)
    small = C.compact(d.where("pos < 3"), "glm-4.7")[0]
    assert small.where("level = 'Q8'").count() == 9


def test_thinking_blocks(spark):
    from tierflow.functions import text as T
    d = spark.createDataFrame([([("thinking", "x"), ("text", "a"), ("text", "b")],)], "b array<struct<type:string,text:string>>")
    r = d.select(T.block_text(F.col("b")).alias("t"), F.size(T.strip_thinking(F.col("b"))).alias("n")).first()
    assert r.t == "a b" and r.n == 2

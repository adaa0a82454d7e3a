"""Retrieval by blocks of profiles and sets, and the index stream over a table in several files."""

import random

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tierflow.operators import retrieval as I
from tierflow.streaming import streams as Z


def test_best_sets_in_small_groups():
    rng = random.Random(4)
    words = {w: rng.sample(range(9), rng.randint(1, 4)) for w in range(8)}
    sets = {s * 3 + 1: rng.sample(range(7), rng.randint(1, 5)) for s in range(25)}
    profiles = {p: [rng.randrange(8) for _ in range(rng.randint(1, 6))] for p in range(30)}
    asked = pa.table({"p": pa.array([*profiles, *[None] * 8], pa.int64()), "w": pa.array([*[None] * 30, *words], pa.int64()),
                      "ids": pa.array([*profiles.values(), *words.values()], pa.list_(pa.int64()))})
    right = pa.table({"s": pa.array(list(sets)[::-1], pa.int64()), "ids": pa.array(list(sets.values())[::-1], pa.list_(pa.int64()))})
    want = set()
    for p, ws in profiles.items():
        scored = sorted((-sum(bool(set(words[w]) & set(t)) for w in ws), s) for s, t in sets.items())
        want |= {(p, s, -n) for n, s in scored[:3] if n}
    for at_once in (1, 50, 1 << 21):
        got = I._best_sets(3, at_once)(asked, right)
        assert set(zip(*(got[c].to_pylist() for c in ("p", "s", "score")))) == want and got.num_rows == len(want)
    empty = I._best_sets(3)(asked, right.slice(0, 0)), I._best_sets(3)(asked.slice(0, 0), right)
    assert all(t.num_rows == 0 and t["p"].type == pa.int64() for t in empty)


def test_retrieve_over_many_blocks(spark, monkeypatch):
    """A word that every query and every entry has pairs all with all; copies of entries and lists, nulls and an empty list."""
    monkeypatch.setattr(I, "BLOCK_PROFILES", 7)
    monkeypatch.setattr(I, "BLOCK_SETS", 6)
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(12)] + ["word", "common", "uncommonly"]
    entries = [(i, 100 - i // 2, ["common", *rng.sample(vocab, i % 4)], ["tag"] if i % 3 else []) for i in range(50)] + [(99, 1, None, None)]
    queries = [(i, ["common"] * (1 + i % 2) + rng.sample(vocab, i % 5)) for i in range(45)] + [(98, None), (97, []), (96, ["word1"]), (95, ["word1"])]
    e = spark.createDataFrame(entries, "entry_id long, created long, keywords array<string>, tags array<string>")
    q = spark.createDataFrame(queries, "query_id long, keywords array<string>")
    want = set()
    for qid, kws in queries:
        scored = sorted((-sum(any(k in t or t in k for t in set((ks or []) + (tg or []))) for k in kws or []), c, i) for i, c, ks, tg in entries)
        want |= {(qid, n, -s, i) for n, (s, _, i) in enumerate([x for x in scored if x[0] < 0][:4], 1)}
    assert {tuple(r) for r in I.retrieve(q, e, 4).collect()} == want
    assert I.retrieve(q, e.where("false")).count() == 0 and I.retrieve(q.where("false"), e).count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_index_stream_over_a_folder_of_files(spark, tmp_path, files):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"kafka{c % 3} redistribute database{t} question number{c}") for c in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(files).write.parquet(f"{tmp_path}/conversations.parquet")
    assert Z.run_to_table(Z.table_stream(spark, str(tmp_path), "conversations")).count() == len(rows)
    q = entry.queries()
    got, want = (sorted(tuple(r[c] for c in ("query_id", "rank", "score", "entry_id")) for r in q[n](spark, str(tmp_path)).collect())
                 for n in ("z5_index_stream", "r1_retrieve"))
    assert got == want and len(got) == 36


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Staged tables look small to Spark, also below the explode into substrings; at 60 times sf0.1 the driver ran full of them."""
    plans, kept = [], I.staged
    monkeypatch.setattr(I, "staged", lambda df: plans.append(df) or kept(df))
    e = spark.createDataFrame([(i, i, [f"word{i}"], ["tag"], "light", 0.5) for i in range(9)],
                              "entry_id long, created long, keywords array<string>, tags array<string>, tier string, adequacy double")
    q = spark.createDataFrame([(i, [f"word{i}", "ordinary"]) for i in range(9)], "query_id long, keywords array<string>")
    plans += [I.retrieve(q, e), I.retrieval_signal(q, e), I.consensus_label(q, e)]
    plans.append(I.containment_pairs(kept(spark.sql("select 'ordinary' kw")), kept(spark.sql("select 'ordinary' term"))))
    found = [p for p in (d._jdf.queryExecution().executedPlan().toString() for d in plans) if "Broadcast" in p]
    assert len(plans) > 20 and not found

"""Two rounds of questions and answers: the first answers are worked out once, and in time that the number of buckets does not raise."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tierflow.llm import common
from tierflow.llm.suffix_dedup import _Bytes, suffix_dedup
from tierflow.llm.windows import SharedWindows


def _asked(buckets, total=200_000):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 32, total, dtype=np.uint32)
    for b in range(buckets):
        own = np.unique(rng.choice(pool, total // buckets))
        yield b, (own[1::20], own[::20], [(b"one", 5 + b), (bytes([b % 256, b // 256]), b)])


def test_first_answers_by_plain_counts():
    asked = list(_asked(40, 20_000))
    n = Counter(x for _, (once, more, _) in asked for x in [*once.tolist(), *more.tolist(), *more.tolist()])
    got = list(SharedWindows(50, 20).answer_first(asked))
    assert [b for b, _ in got] == list(range(40)) and any(c == 1 for c in n.values())
    for (_, (once, more, _)), (_, (again, same)) in zip(asked, got):
        assert again.dtype == np.uint32 and again.tolist() == [x for x in [*once.tolist(), *more.tolist()] if n[x] > 1]
        assert same == [(b"one", 5)]
    none = np.zeros(0, np.uint32)
    (b, (again, same)), = SharedWindows(50, 20).answer_first([(7, (none, none, []))])
    assert b == 7 and len(again) == 0 and same == []


def test_first_answers_take_no_longer_for_many_buckets():
    def seconds(buckets):
        asked, began = list(_asked(buckets)), time.thread_time()
        list(SharedWindows(50, 20).answer_first(asked))
        return time.thread_time() - began
    assert seconds(800) < 5 * seconds(20) + 0.5


def test_first_answers_are_worked_out_once(spark, tmp_path):
    line = "the quick brown fox jumps over the lazy dog and runs away from it, "
    docs = spark.createDataFrame([(i, f"{i} " * 9 + line + f" {i * i}" * 30) for i in range(60)], "doc_id long, text string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffix_dedup(docs).schema)
    calls = f"{tmp_path}/calls"

    class Noted(_Bytes):  # in here, else workers would look for this module
        def answer_first(self, asked):
            with open(calls, "a") as f:
                f.write("x\n")
            yield from _Bytes.answer_first(self, asked)

    job = Noted(50, 20)
    got = common.two_rounds(common.doc_rows(docs), job, schema)
    out = got.agg(F.count(F.lit(1)), F.sum("n_removed")).first()
    assert out[0] == 60 and out[1] >= 59 * len(line)
    assert len(open(calls).readlines()) <= job.shards

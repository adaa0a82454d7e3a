"""Features and labels are computed once, and white space is cheap to tell."""

import random

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S, text as T
from tierflow.operators import dataset as D, fit as M


def _counted(df):
    """The rows, and a count of how often one of them was computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(count, df.schema), seen


def test_space_tokens_of_every_code_point(spark):
    points = [*range(0x3100), *range(0xFE00, 0x10100), 0x1F600, 0x10FFFF]
    d = spark.createDataFrame([(chr(c),) for c in points], "c string")
    char = F.col("c")
    t = F.concat(F.lit("a"), char, F.lit("b"), char, char)
    old = F.regexp_count(t, F.lit(f"[^{T.SPACE}]+"))
    assert d.where(~T.space_token_count(t).eqNullSafe(old) | ~T.space_token_count(char).eqNullSafe(F.regexp_count(char, F.lit(f"[^{T.SPACE}]+")))).count() == 0
    assert spark.sql("select cast(null as string) t").select(T.space_token_count(F.col("t"))).first()[0] is None


def test_label_score_is_computed_once(spark):
    d = S.label_signals(spark.createDataFrame([("How do I fix this?",)], "text string").repartition(2))
    assert d._jdf.queryExecution().optimizedPlan().toString().lower().count("log1p") == 1


def test_fit_reads_its_input_once(spark):
    rng = random.Random(1)
    rows = [(i, int(i % 3 == 0), [float(rng.randrange(5)) + (i % 3 == 0) for _ in V.FEATURE_NAMES]) for i in range(300)]
    d, seen = _counted(spark.createDataFrame(rows, "id long, target int, vec array<double>"))
    r = M.fit_binary(d)
    assert (r["n_pos"], r["n_neg"]) == (100, 100) and seen.value == 300


def test_training_run_reads_its_input_once(spark):
    rows = [(i, f"prompt {i} " + "word " * (i % 7) + ("why?" if i % 2 else "fix the api"), V.TIERS[i % 6]) for i in range(240)]
    d, seen = _counted(spark.createDataFrame(rows, "id long, text string, label string"))
    assert sum(r["n"] for r in M.training_run(d)["labels"].collect()) == 240 and seen.value == 240


def test_validation_reads_its_input_once(spark):
    rows = [("a", "same text", 2.0)] * 30 + [("b" if i % 2 else None, f"text number {i}", 3.0) for i in range(70)]
    d, seen = _counted(spark.createDataFrame(rows, "label string, text string, word_count double"))
    r = D.validate_dataset(d).first()
    assert r["sample_count"] == 100 and r["duplicate_rate"] == .29 and seen.value == 100

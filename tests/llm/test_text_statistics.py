"""Counts of whole texts equal those of their patterns."""

import random

import regex

from tierflow.llm import text_statistics as T


def brute(text):
    left = {k: len(regex.sub(p, "", text)) for k, (p, _) in T.CLASSES.items()}
    found = {k: sum(1 for _ in regex.finditer(p, text)) for k, (p, _) in T.MATCHES.items()}
    return {**left, **found, "chars": len(text), "words": len(regex.findall(r"\S+", text))}


def check(texts):
    got = T.counts(texts)
    for i, t in enumerate(texts):
        assert {k: got[k][i] for k in got} == brute(t), t


def test_counts_equal_patterns():
    rng = random.Random(1)
    check(["", "a", " ", "a a", "\n", "!!", "a!!b..c", "Ab, c. d.\n\n e e e", "x" * 40, "e", "e"]
          + ["".join(rng.choice("aA1é中.,!?; \n\U0001f600aab ") for _ in range(rng.randrange(60))) for _ in range(2000)])
    for texts in ([""], ["", ""], ["a"], [" "]):
        check(texts)


def test_blocks_and_odd_rows(spark, monkeypatch):
    rows = [(1, "One two two."), (None, None), (1, "One two two."), (2, ""), (3, "ab " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["s"]["log_chars"], r["s"]["repeated_word_share"]) for r in T.with_statistics(df).collect()}
    want = {(i, float(T.shares([t or ""])["log_chars"][0]), float(T.shares([t or ""])["repeated_word_share"][0])) for i, t in rows}
    assert got == want and T.with_statistics(df).count() == len(rows)
    assert T.with_statistics(df.where("doc_id = 99")).count() == 0
    bad = spark.sql("SELECT 1L doc_id, CAST(X'61FF62' AS STRING) text")
    assert T.with_statistics(bad).first()["s"]["letter_share"] == 2 / 3

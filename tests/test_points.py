"""Known points of tiers, features, scores, routes and costs."""

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import features as X, scoring as S, text as T
from tierflow.operators import routing as R


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(spark, text, fn):
    return fn(spark.createDataFrame([(text,)], "text string")).first()


def test_tier_bounds(spark):
    classic = [(.01, "trivial"), (.05, "trivial"), (.10, "light"), (.15, "light"), (.20, "moderate"), (.30, "moderate"),
               (.35, "heavy"), (.50, "heavy"), (.55, "intensive"), (.70, "intensive"), (.75, "extreme"), (.95, "extreme")]
    d = spark.createDataFrame(classic, "s double, want string").withColumn("got", S.tier_classic(F.col("s")))
    assert all(r.want == r.got for r in d.collect())
    cal = [(.05, "trivial"), (.16, "light"), (.25, "moderate"), (.30, "heavy"), (.40, "intensive"), (.80, "extreme")]
    d = spark.createDataFrame(cal, "s double, want string").withColumn("got", S.tier_calibrated(F.col("s")))
    assert all(r.want == r.got for r in d.collect())


def test_feature_flags(spark):
    f = lambda t: one(spark, t, X.prompt_features)
    assert f("hello").word_count == 1 and f("hello").has_code == 0
    q = f("How do I implement a REST API with Docker and Kubernetes?")
    assert q.has_question == 1 and q.technical_terms == 4 and q.question_technical == 1
    assert f("```python\ndef hello():\n    print('hi')\n```").has_code == 1
    assert f("Design a distributed event-driven microservice architecture with load balancer").architecture == 1
    assert f("First, create the API. Then add auth. Finally, deploy to production.").multi_step == 1
    assert f("École élève a_b 12").word_count == 4
    assert f("address me").has_imperative == 1  # prefix without a word end
    assert f("authentication").multi_step == 1


def test_four_plus(spark):
    r = one(spark, "Write `x`: how do api, docker and redis work?", X.prompt_features)
    assert r.four_plus == 1


def test_scores_and_routes(spark):
    d = spark.createDataFrame([
        (1, "hello"), (2, "Design a distributed event-driven microservice architecture for a fintech payment system "
         "with real-time fraud detection, Kubernetes deployment, and disaster recovery failover"),
        (3, "Write a Python function that sorts a list using merge sort and explain the time complexity"),
        (4, "What is Python?")], "id int, text string")
    got = {r.id: r for r in R.score_prompts(d).collect()}
    assert len(got) == 4 and all(r.tier in V.TIERS and r.method == "cascade" for r in got.values())
    assert got[1].tier in ("trivial", "light") and got[2].tier in ("heavy", "intensive", "extreme")
    assert got[3].tier in ("light", "moderate", "heavy")
    assert all(0 <= r.score <= 1 and r.confidence <= .99 for r in got.values())
    o = spark.createDataFrame([(t, "m-" + t, "test", 1) for t in V.TIERS + ["bogus"]],
                              "tier string, model string, provider string, max_tokens long")
    r = R.score_prompts(d, R.override_routes(R.routes(spark), o)).collect()
    assert all(x.model == "m-" + x.tier and x.provider == "test" for x in r)
    assert R.override_routes(R.routes(spark), o).count() == 6


def test_cascade_weights_shape():
    assert len(V.CASCADE_WEIGHTS) == 5 and len(V.FEATURE_NAMES) == 15
    assert all(len(w) == 15 for _, w in V.CASCADE_WEIGHTS.values())


def test_signal_score(spark):
    s = lambda t: one(spark, t, S.signal_score)
    assert s("hi").score < .3 and s("").score == 0 and s("").tier == "trivial"
    assert s("What is the weather?").score < .5
    assert s("Write a function to sort an array").score > .4
    assert s("def foo(): return 1").score > .2
    assert s("Design a scalable distributed architecture with a database schema").score > s("hello there").score


def test_gateway_features_blank_and_blocks(spark):
    r = one(spark, "  ", X.gateway_features)
    assert all(r[n] == 0 for n in X.GATEWAY_FEATURES)
    r = one(spark, "Acme Corp pays $5M by tomorrow, do not use XML. ```\na\nb\n```", X.gateway_features)
    assert r.entity_count == 3 and r.code_block_size == 4 and r.temporal_references == 1 and r.has_negation == 1


def test_costs(spark):
    d = spark.createDataFrame([
        (1, "openrouter/owl-alpha", 1000, 500), (2, "z-ai/glm-4.7-flash", 1000, 500), (3, "qwen/qwen-plus", 1000, 500),
        (4, "anthropic/claude-sonnet-4.6", 1000, 500), (5, "anthropic/claude-opus-4.6", 1000, 500),
        (6, "openrouter/z-ai/glm-4.7-flash", 1000, 500), (7, "no-such-model", 1000, 500), (8, "qwen/qwen-plus", 0, 0)],
        "id int, routed_model string, tokens_in long, tokens_out long")
    c = {r.id: r for r in R.request_cost(d, R.pricing(spark)).collect()}
    assert c[1].cost_usd == 0 and c[1].savings_pct == 100
    assert c[2].cost_usd < .001 and c[2].savings_pct > 95 and c[3].savings_pct > 80 and c[4].savings_pct >= 40 - 1e-9
    assert abs(c[5].savings_pct) < 1e-9 and c[6].cost_usd == c[2].cost_usd
    assert c[7].cost_usd == 0 and not c[7].priced and c[8].cost_usd == 0 and c[8].savings_pct == 0


def test_vote_replies(spark):
    want = {"yes": (True, None), "✅": (True, None), "no": (False, None), "wrong heavy": (False, "heavy"),
            "correct light": (False, "light"), "maybe later": (None, None), " NO Trivial ": (False, "trivial")}
    d = spark.createDataFrame([(k,) for k in want], "t string")
    a, t = T.parse_vote_reply(F.col("t"))
    for r in d.select("t", a.alias("a"), t.alias("c")).collect():
        assert (r.a, r.c) == want[r.t]


def test_key_decisions_and_summary(spark):
    d = spark.createDataFrame([("Decision: use kafka\nNote that redis is out. password=abc",)], "t string")
    r = d.select(T.key_decisions(F.col("t")).alias("k"), T.safe_summary(F.col("t")).alias("s")).first()
    assert r.k == ["use kafka", "redis is out. password=abc"] and "password=***REDACTED***" in r.s


def test_short_chunks_stay(spark):
    from tierflow.functions import text as T
    body = "def long(x):\n    return " + "x + " * 30 + "x\n"
    d = spark.createDataFrame([(body + "def f(): pass\n", ".py")], "text string, suffix string")
    assert [r.chunk for r in T.chunk_text(d, suffix="suffix").collect()] == [body.strip(), "def f(): pass"]
    assert [r.chunk for r in T.chunk_text(d, suffix="suffix", minimum=50).collect()] == [body.strip()]


def test_chunks(spark):
    code = "import os\n" + "x = 1\n" * 20 + "def f():\n" + "    pass\n" * 20
    md = "# One\n" + "a " * 50 + "\n## Two\n" + "b " * 50
    d = spark.createDataFrame([(code, ".py"), (md, ".md"), ("z" * 9000, ".xyz"), ("tiny", ".xyz")], "text string, suffix string")
    got = {}
    for r in T.chunk_text(d, suffix="suffix").collect():
        got.setdefault((r.suffix, r.text[:4]), []).append(r.chunk)
    assert len(got[(".py", "impo")]) == 2 and got[(".py", "impo")][1].startswith("def f")
    assert len(got[(".md", "# On")]) == 2 and [len(c) for c in got[(".xyz", "zzzz")]] == [4000, 4000, 2000]
    assert got[(".xyz", "tiny")] == ["tiny"]

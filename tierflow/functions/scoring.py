"""Scores, tiers and gates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions.num import even, rnd
from tierflow.functions import features as X


def tier_array() -> Column:
    return F.array(*[F.lit(t) for t in V.TIERS])


def tier_at(index: Column) -> Column:
    """Tier name of a zero-based index, clamped to the known range; null stays null."""
    clamped = F.least(F.greatest(index, F.lit(0)), F.lit(5)).cast("int")
    return F.when(index.isNotNull(), F.get(tier_array(), clamped))


def tier_index(tier: Column) -> Column:
    """Zero-based index, null when unknown."""
    pos = F.array_position(tier_array(), tier)
    return F.when(pos > 0, (pos - 1).cast("int"))


def tier_from_bounds(score: Column, bounds) -> Column:
    out = F.lit(V.TIERS[-1])
    for bound, tier in reversed(list(zip(bounds, V.TIERS))):
        out = F.when(score < bound, tier).otherwise(out)
    return out


def tier_classic(score: Column) -> Column:
    return tier_from_bounds(score, V.CLASSIC_BOUNDS)


def tier_calibrated(score: Column, bounds=V.CALIBRATED_BOUNDS) -> Column:
    return tier_from_bounds(score, bounds)


def lookup(values: dict, key: Column, default: float) -> Column:
    out = F.lit(float(default))
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, float(v)).otherwise(out)
    return out


def tier_value(tier: Column, values=V.TIER_MIDPOINTS, default: float = 0.25) -> Column:
    return lookup(values, tier, default)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def heuristic_score(weights=V.DEFAULT_WEIGHTS) -> Column:
    """Weighted sum over the 15 prompt features; short prompts are damped."""
    def term(name, value):
        return F.lit(float(weights.get(name, 0.0))) * value
    f = F.col
    s = (term("sentence_count", F.least(f("sentence_count"), F.lit(10.0)) / 10.0)
         + term("avg_word_length", f("avg_word_length") / 10.0)
         + term("has_question", f("has_question"))
         + term("question_technical", f("question_technical"))
         + term("technical_design", f("technical_design"))
         + term("code", f("has_code"))
         + term("architecture", f("architecture"))
         + term("word_count", F.log1p("word_count") / 6.0)
         + term("four_plus", f("four_plus"))
         + term("has_imperative", f("has_imperative"))
         + term("technical_terms", F.least(f("technical_terms"), F.lit(10.0)) / 10.0)
         + term("multi_step", f("multi_step"))
         + term("requires_context", f("requires_context"))
         + term("domain_specificity", f("domain_specificity"))
         + term("ambiguity_score", f("ambiguity_score")))
    damp = F.when((f("word_count") < 10) & (f("architecture") == 0), 0.7).otherwise(1.0)
    return clamp(s * damp)


def system_bonus(words: Column, count: Column) -> Column:
    return (F.when((words >= 15) & (count >= 5), 0.35)
            .when((words >= 15) & (count >= 4), 0.25)
            .when((words >= 12) & (count >= 3), 0.15)
            .when((words >= 10) & (count >= 3), 0.10)
            .when((words >= 10) & (count >= 2), 0.05)
            .when(count >= 2, 0.03).otherwise(0.0))


def raw_signal_score() -> Column:
    """Unclamped score on the columns of ``signal_count``; tiers come from this value."""
    return (F.col("signals") * 0.15 + F.log1p("ws_words") * 0.08
            + F.when(F.col("has_context"), 0.1).otherwise(0.0)
            + system_bonus(F.col("ws_words"), F.col("system_words")))


def signal_score(df: DataFrame, text: str = "text") -> DataFrame:
    d = X.signal_count(df, text).withColumn("__raw", raw_signal_score())
    return (d.withColumn("score", clamp(F.col("__raw")))
            .withColumn("tier", tier_calibrated(F.col("__raw"))).drop("__raw"))


def gateway_heuristic() -> Column:
    """Score on the columns of ``gateway_features``."""
    f = F.col
    signals = sum([f(s) for s in X.SIGNALS[1:]], f(X.SIGNALS[0]))
    count = (f("has_architecture") + f("technical_design")
             + F.when(f("technical_terms") > 3, 1.0).otherwise(0.0) + f("multi_domain"))
    return clamp(signals * 0.15 + F.log1p("ws_words") * 0.08 + f("has_context") * 0.1
                 + system_bonus(f("ws_words"), count))


def logit(vector: list[Column], weights: list[float], intercept: float) -> Column:
    """Unrolled dot product; zero weights are dropped."""
    out = None
    for v, w in zip(vector, weights):
        if w != 0.0:
            term = v * float(w)
            out = term if out is None else out + term
    return (out if out is not None else F.lit(0.0)) + float(intercept)


def feature_columns(code_slot: str = "zero") -> list[Column]:
    code = F.lit(0.0) if code_slot == "zero" else F.col("has_code")
    return [code if n == "code" else F.col(n) for n in V.FEATURE_NAMES]


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def cascade_logits(weights=V.CASCADE_WEIGHTS, code_slot: str = "zero") -> list[Column]:
    cols = feature_columns(code_slot)
    return [logit(cols, weights[t][1], weights[t][0]) if t in weights else F.lit(0.0)
            for t in V.CASCADE_TIERS]


def cascade_score(df: DataFrame, weights=V.CASCADE_WEIGHTS, code_slot: str = "zero") -> DataFrame:
    """Pairwise decode over ``prompt_features``: adds score, tier, confidence, method.

    Without all five classifiers the heuristic alone decides.
    """
    if not weights or any(t not in weights for t in V.CASCADE_TIERS):
        return (df.withColumn("score", heuristic_score())
                .withColumn("tier", tier_classic(F.col("score")))
                .withColumn("confidence", even("score", 4))
                .withColumn("method", F.lit("heuristic")))
    # separate columns: items of an array column would be inlined into every use
    d = df.select("*", heuristic_score().alias("__h"),
                  *[c.alias(f"__l{i}") for i, c in enumerate(cascade_logits(weights, code_slot))])
    d = d.select("*", *[(F.col(f"__l{i}") - F.col(f"__l{i + 1}")).alias(f"__d{i}") for i in range(4)])
    pick = F.lit(4)
    for i in reversed(range(4)):
        pick = F.when(F.col(f"__d{i}") > 0, i).otherwise(pick)
    d = d.withColumn("__pick", pick)
    win = F.coalesce(*[F.when(F.col("__pick") == i, F.col(f"__d{i}")) for i in range(4)])
    mid = F.element_at(F.array(*[F.lit(V.TIER_MIDPOINTS[t]) for t in V.TIERS[:4] + ["extreme"]]), F.col("__pick") + 1)
    conf = F.when(F.col("__pick") == 4, 0.5).otherwise(F.least(sigmoid(win), F.lit(0.99)))
    return (d.withColumn("score", even(clamp(0.6 * F.col("__h") + 0.4 * mid), 4))
            .withColumn("tier", tier_classic(F.col("score")))
            .withColumn("confidence", even(conf, 4))
            .withColumn("method", F.lit("cascade"))
            .drop("__h", "__pick", *[f"__l{i}" for i in range(5)], *[f"__d{i}" for i in range(4)]))


def first_yes(weights=V.CASCADE_WEIGHTS, code_slot: str = "zero",
              thresholds: dict | None = None) -> Column:
    """First tier whose probability passes its threshold (.5 unless given), else extreme."""
    cols = feature_columns(code_slot)
    out = F.lit("extreme")
    for tier in reversed(V.CASCADE_TIERS):
        if tier in weights:
            p = (thresholds or {}).get(tier, 0.5)
            # p > t is logit > ln(t / (1 - t)): no exponential needed
            cut = math.log(p / (1.0 - p))
            out = F.when(logit(cols, weights[tier][1], weights[tier][0]) > cut, tier).otherwise(out)
    return out


def gated_tier(weights=V.CASCADE_WEIGHTS, gates=None, default: str = "intensive") -> Column:
    """Cheapest tier whose own classifier is sure enough, else the safe tier."""
    gates = dict(gates or V.PROBABILITY_GATES)
    cols = feature_columns()
    out = F.lit(default)
    for tier in reversed(list(gates)):
        cut = math.log(gates[tier] / (1.0 - gates[tier]))
        out = F.when(logit(cols, weights[tier][1], weights[tier][0]) > cut, tier).otherwise(out)
    return out


def sigmoid_score(weights: list[float], intercept: float = 0.0) -> Column:
    """Sigmoid of one weight vector over the normalised ``cascade_features``."""
    return sigmoid(logit([F.col(n) for n in V.FEATURE_NAMES], weights, intercept))


def label_signals(df: DataFrame, text: str = "text", out: str = "label") -> DataFrame:
    """Formula label for prompts that carry none."""
    from tierflow.functions import text as T
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = (df.withColumn("__lower", F.lower(t))
         .withColumn("__wc", T.space_token_count(t))
         .withColumn("__ctx", T.any_of(low, V.LABEL_CONTEXT)))
    conds = [
        t.contains("?"), T.any_of(low, V.LABEL_CODE),
        low.rlike("^" + T.alternatives(V.SIGNAL_IMPERATIVES) + " "),
        t.rlike(r"[0-9]\s*[+\-*/=]"), T.any_of(low, V.LABEL_SEQUENCE),
        T.any_of(low, V.LABEL_CONSTRAINT), F.col("__ctx"),
        T.any_of(low, V.SIGNAL_ARCHITECTURE), T.any_of(low, V.SIGNAL_DESIGN)]
    n = sum([c.cast("int") for c in conds[1:]], conds[0].cast("int"))
    score = n * 0.15 + F.log1p("__wc") * 0.08 + F.when(F.col("__ctx"), 0.1).otherwise(0.0)
    # the bounds name the score five times; as a column it is computed once
    return d.withColumn("__score", score).select(*cols, tier_from_bounds(F.col("__score"), V.LABEL_BOUNDS).alias(out))


def label_rules() -> Column:
    """Rule label on ``sample_features``; earlier rules win."""
    f = F.col
    arch, design, multi = f("architecture"), f("technical_design"), f("multi_step")
    return (F.when((f("word_count") < 50) & ~f("has_code") & (f("technical_terms") == 0) & ~multi,
                   "trivial")
            .when(arch & design & multi, "extreme")
            .when(arch & (multi | f("requires_context")), "intensive")
            .when((f("word_count") > 300) & (multi | design), "heavy")
            .when(f("has_code") | (f("technical_terms") >= 3), "moderate")
            .when((f("word_count") < 200) & ~multi & ~arch & (f("technical_terms") <= 2), "light")
            .otherwise("moderate"))


def label_missing(df: DataFrame, text: str = "text") -> DataFrame:
    """Fill null labels by rule, confidence .85; present labels stay."""
    d = X.sample_features(df.drop("__none"), text)
    names = set(df.columns)
    conf = F.col("confidence") if "confidence" in names else F.lit(1.0)
    return (d.withColumn("confidence", F.when(F.col("label").isNull(), 0.85).otherwise(conf))
            .withColumn("label", F.coalesce("label", label_rules())))


def normalise_weights(weights: dict) -> dict:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(weights)


def normalised_columns(names: list[str]) -> dict[str, Column]:
    """The same for weights held in columns."""
    total = sum([F.col(n) for n in names[1:]], F.col(names[0]))
    return {n: F.when(total > 0, F.col(n) / total).otherwise(F.col(n)) for n in names}


def ensemble_vote(df: DataFrame, heuristic: str = "heuristic", retrieval: str = "retrieval",
                  bias: str = "bias", cascade: str | None = None,
                  weights=V.ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted vote with confidence-based escalation. The history term is added
    unweighted, and without a cascade the confidence is a constant .7."""
    h, r = F.col(heuristic), F.coalesce(F.col(retrieval), F.lit(0.5))
    b = F.coalesce(F.col(bias), F.lit(0.0))
    c = F.col(cascade) if cascade else F.lit(None).cast("double")
    plain = h * weights["heuristic"] + r * weights["retrieval"] + b
    full = h * weights["heuristic"] + c * weights["cascade"] + r * weights["retrieval"] + b
    mean = (h + c + r) / 3.0
    var = (F.pow(h - mean, 2) + F.pow(c - mean, 2) + F.pow(r - mean, 2)) / 3.0
    d = (df.withColumn("final_score", clamp(F.when(c.isNull(), plain).otherwise(full)))
         .withColumn("confidence", F.when(c.isNull(), 0.7)
                     .otherwise(F.greatest(F.lit(0.0), 1.0 - F.sqrt(var) * 3.0)))
         .withColumn("method", F.when(c.isNull(), "heuristic-fallback").otherwise("ensemble")))
    d = d.withColumn("__t", tier_calibrated(F.col("final_score")))
    idx = tier_index(F.col("__t"))
    up = F.when(F.col("confidence") < 0.5, "intensive") \
        .when((F.col("confidence") < 0.8) & (idx < 5), tier_at(idx + 1)).otherwise(F.col("__t"))
    escalated = (F.col("confidence") < 0.5) | ((F.col("confidence") < 0.8) & (idx < 5))
    return d.withColumn("tier", up).withColumn("escalated", escalated).drop("__t")


def assess_response(df: DataFrame, response: str = "response", tier: str = "predicted_tier",
                    latency: str = "latency_ms") -> DataFrame:
    """How well the tier fitted, judged from the response alone."""
    from tierflow.functions import text as T
    n = T.space_token_count(F.coalesce(F.col(response), F.lit("")))
    d = df.withColumn("response_words", n.cast("long"))
    w = F.col("response_words")
    pred = tier_value(F.col(tier))
    pred0 = tier_value(F.col(tier), default=0.0)
    over = (pred > 0.4) & (w < 50)
    under = (pred < 0.2) & ((w > 500) | (F.col(latency) > 5000))
    ladder = (F.when(w < 30, "trivial").when(w < 100, "light").when(w < 300, "moderate")
              .when(w < 800, "heavy").when(w < 2000, "intensive").otherwise("extreme"))
    est = tier_value(ladder, default=0.0)
    return (d.withColumn("actual_tier",
                         F.when(over, F.when(w < 20, "trivial").otherwise("light"))
                         .when(under, F.when(w < 1000, "moderate").otherwise("heavy"))
                         .otherwise(ladder))
            .withColumn("self_rating", rnd(
                F.when(over, 0.3).when(under, 0.4)
                .otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(pred0 - est) * 3.0)), 2))
            .withColumn("was_overkill", F.when(over, True).when(under, False)
                        .otherwise(pred0 > est + 0.2))
            .withColumn("was_underkill", F.when(over, False).when(under, True)
                        .otherwise(pred0 < est - 0.1)))


def quick_adequacy(response: Column, tier: Column, tokens_out: Column, latency: Column,
                   error: Column | None = None) -> Column:
    from tierflow.functions import text as T
    lo = lookup({t: a for t, a, _ in V.ADEQUACY_TOKEN_RANGES}, tier, 50)
    hi = lookup({t: b for t, _, b in V.ADEQUACY_TOKEN_RANGES}, tier, 1000)
    tokens = (F.when((tokens_out >= lo) & (tokens_out <= hi), 0.4)
              .when(tokens_out < lo, F.greatest(F.lit(0.0), (tokens_out / lo) * 0.4))
              .otherwise(F.greatest(F.lit(0.1), (hi / tokens_out) * 0.4)))
    words = T.space_tokens(F.lower(F.coalesce(response, F.lit(""))))
    n = F.size(words)
    length = F.when((n > 5) & (n < 2000), 0.2).when(n <= 5, 0.05).otherwise(0.1)
    speed = (F.when(latency > 30000, 0.1)
             .when((latency < 200) & (tier != "trivial"), 0.05).otherwise(0.2))
    unique = F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))
    repeat = F.when(unique > 0.7, 0.2).when(unique > 0.4, 0.1).otherwise(0.05)
    total = F.least(F.lit(1.0), tokens + length + speed + repeat)
    return total if error is None else F.when(error, 0.1).otherwise(total)

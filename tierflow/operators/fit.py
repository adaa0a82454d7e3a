"""Model fitting: iterations run on Spark, only weights and small matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions import features as X, scoring as S
from tierflow.operators.dataset import balanced_sample
from tierflow.operators.scale import dimension, staged

N = len(V.FEATURE_NAMES)


def fit_binary(df: DataFrame, target: str = "target", vector: str = "vec", id_col: str = "id", c: float = 1.0,
               iterations: int = 1000, minimum: int = 10, seed: int = 42) -> dict | None:
    """L2 logistic regression on a balanced sample; None when a class is too small."""
    d = staged(df.select(id_col, target, vector))  # the sample reads its input three times; vectors are computed once
    s = staged(balanced_sample(d, target, id_col, seed, minimum)
               .select(F.col(target).cast("double").alias("label"), vector))
    counts = {r["label"]: r["n"] for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations, regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True)
    model = lr.fit(s.select("label", array_to_vector(vector).alias("features")))
    w, b = [round(float(x), 6) for x in model.coefficients], round(float(model.intercept), 6)
    raw = S.logit([F.col(vector)[i] for i in range(N)], w, b)
    right = s.agg(F.avg(((raw > 0).cast("double") == F.col("label")).cast("double")).alias("a")).first()["a"]
    return {"weights": w, "intercept": b, "accuracy": round(right, 4), "n_pos": counts[1.0], "n_neg": counts[0.0]}


def _vectors(df: DataFrame, vector) -> DataFrame:
    return staged(df.select("id", S.tier_index(F.col("label")).alias("t"), vector.alias("vec")))


def fit_cascade(df: DataFrame, code_slot: str = "zero") -> dict:
    """Five classifiers, each on the rows of its tier and above. Expects prompt features,
    id and label; returns results by tier, leaving out tiers with too few rows."""
    d = _vectors(df, X.to_vector(code_slot))
    out = {}
    for i, tier in enumerate(V.CASCADE_TIERS):
        r = fit_binary(d.where(F.col("t") >= i).withColumn("target", (F.col("t") == i).cast("int")))
        if r:
            out[tier] = r
    return out


def fit_cascade_ordinal(df: DataFrame) -> dict:
    """Boundary variant on the normalised features: positive is "this tier or above". The
    first boundary has no negatives and is left out."""
    d = _vectors(df, F.array(*[F.col(n).cast("double") for n in V.FEATURE_NAMES]))
    out = {}
    for i, tier in enumerate(V.CASCADE_TIERS):
        r = fit_binary(d.withColumn("target", (F.col("t") >= i).cast("int")), minimum=5)
        if r:
            out[tier] = r
    return out


def as_weights(fitted: dict) -> dict:
    return {t: (r["intercept"], r["weights"]) for t, r in fitted.items()}


def weights_table(spark, fitted: dict) -> DataFrame:
    """(tier, accuracy, n_pos, intercept, feature, weight): at most 75 rows."""
    rows = [(t, r["accuracy"], int(r["n_pos"]), r["intercept"], f, w)
            for t, r in fitted.items() for f, w in zip(V.FEATURE_NAMES, r["weights"])]
    cols = ["tier", "accuracy", "n_pos", "intercept", "feature", "weight"]
    return dimension(spark, cols, rows or [(None,) * 6])


def top_features(weights: DataFrame, n: int = 5) -> DataFrame:
    """Strongest features of each classifier by absolute weight."""
    from pyspark.sql import Window
    w = Window.partitionBy("tier").orderBy(F.abs("weight").desc(), "feature")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def gram(df: DataFrame, vector: str = "vec", target: str = "y") -> DataFrame:
    """One row with XᵀX (upper half), Xᵀy, yᵀy and n, from one aggregate."""
    d = df.select(*[F.col(vector)[i].alias(f"x{i}") for i in range(N)], F.col(target).alias("y"))
    aggs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i in range(N) for j in range(i, N)]
    aggs += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b_{i}") for i in range(N)]
    return d.agg(*aggs, F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))


def solve_box(g: np.ndarray, b: np.ndarray, w: np.ndarray, lo: float, hi: float, sweeps: int = 20000) -> np.ndarray:
    """Least squares in a box by coordinate descent on the 15x15 normal equations."""
    w = np.clip(w.astype(float), lo, hi)
    for _ in range(sweeps):
        biggest = 0.0
        for i in range(len(w)):
            if g[i, i] <= 0:
                continue
            new = min(max((b[i] - g[i] @ w + g[i, i] * w[i]) / g[i, i], lo), hi)
            biggest = max(biggest, abs(new - w[i]))
            w[i] = new
        if biggest < 1e-12:
            break
    return w


def fit_weights(df: DataFrame, start=V.DEFAULT_WEIGHTS, hi: float = 0.35) -> dict:
    """Heuristic weights with least squared error against the tier values, within [0, hi]
    and then scaled to sum 1. Expects sample features and label."""
    row = gram(df.select(X.optimiser_vector().alias("vec"), S.tier_value(F.col("label")).alias("y"))).first()
    g = np.zeros((N, N))
    for i in range(N):
        for j in range(i, N):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    b = np.array([row[f"b_{i}"] for i in range(N)])
    x0 = np.array([start.get(f, 0.0) for f in V.FEATURE_NAMES])
    mse = lambda w: float((w @ g @ w - 2 * b @ w + row["yy"]) / row["n"])
    w = solve_box(g, b, x0, 0.0, hi)
    scaled = w / w.sum() if w.sum() > 0 else w
    before, after = mse(x0), mse(scaled)
    return {"weights": dict(zip(V.FEATURE_NAMES, scaled.tolist())), "mse_before": before, "mse_after": after,
            "mse_unscaled": mse(w), "improvement_pct": (1 - after / before) * 100 if before > 0 else 0.0}


def candidate_weights(current=V.ENSEMBLE_WEIGHTS, change: float = 0.20, steps: int = 5) -> list[tuple]:
    """Grid around the current ensemble weights, clamped and scaled to sum 1."""
    limits = {"heuristic": (0.1, 0.7), "cascade": (0.1, 0.7), "retrieval": (0.05, 0.4), "history": (0.05, 0.4)}
    axis = {k: [max(lo, min(hi, current[k] + (i / steps - 0.5) * 2 * change)) for i in range(steps + 1)]
            for k, (lo, hi) in limits.items()}
    out = []
    for h in axis["heuristic"]:
        for c in axis["cascade"]:
            for r in axis["retrieval"]:
                for b in axis["history"]:
                    s = h + c + r + b
                    out.append((len(out), h / s, c / s, r / s, b / s))
    return out


def search_weights(judged: DataFrame, current=V.ENSEMBLE_WEIGHTS, change: float = 0.20, steps: int = 5) -> DataFrame:
    """Right votes of every candidate over judged rows (heuristic, retrieval, bias,
    actual_idx). Equal rows are folded first; tasks then score their rows against the
    fixed candidate list and hand on one count per candidate, so no row is multiplied."""
    grid = candidate_weights(current, change, steps)
    wh, wr = np.array([g[1] for g in grid]), np.array([g[3] for g in grid])
    bounds = np.array(V.CALIBRATED_BOUNDS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros(len(grid), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                p = pdf.iloc[at:at + 2048]
                h, r, b = (p[c].to_numpy()[:, None] for c in ("heuristic", "retrieval", "bias"))
                score = np.clip(h * wh + r * wr + b, 0.0, 1.0)
                vote = np.minimum(np.searchsorted(bounds, score, side="right") + 1, 5)
                hits += ((vote == p["actual_idx"].to_numpy()[:, None]) * p["n"].to_numpy()[:, None]).sum(axis=0)
        yield pd.DataFrame({"candidate": np.arange(len(grid)), "correct": hits})

    rows = (judged.where(F.col("actual_idx").isNotNull())
            .groupBy("heuristic", "retrieval", "bias", "actual_idx").agg(F.count(F.lit(1)).alias("n")))
    found = rows.mapInPandas(count, "candidate long, correct long").groupBy("candidate").agg(
        F.sum("correct").alias("correct"))
    table = dimension(judged.sparkSession, ["candidate", "heuristic", "cascade", "retrieval", "history"], grid)
    return found.join(F.broadcast(table), "candidate")


def best_weights(found: DataFrame, n: int = 1) -> DataFrame:
    return found.orderBy(F.col("correct").desc(), "candidate").limit(n)


def training_run(samples: DataFrame, share: float = 0.8, seed: int = 42) -> dict:
    """Split, baseline, cascade fit and both reports for labelled prompts (id, text, label)."""
    from tierflow.operators.dataset import stratified_split
    from tierflow.operators.feedback import compare_tiers, evaluate
    # the split reads its input three times; features are computed once
    d = staged(stratified_split(staged(X.prompt_features(samples, rounded=False).drop("text")), share=share, seed=seed))
    train, test = d.where("part = 'train'"), d.where("part = 'test'")
    fitted = fit_cascade(train)
    scored = test.select("label", S.tier_classic(S.heuristic_score()).alias("base"),
                         S.first_yes(as_weights(fitted)).alias("tier"))
    n = scored.groupBy("label", "base", "tier").agg(F.count(F.lit(1)).alias("n"))
    baseline, cascade = evaluate(n, "base", "label", "n"), evaluate(n, "tier", "label", "n")
    return {"fitted": fitted, "baseline": baseline, "cascade": cascade, "comparison": compare_tiers(baseline, cascade),
            "labels": d.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))}

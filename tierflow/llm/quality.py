"""Quality by a sparse rule ensemble: paths of small trees over text statistics become rules, and a lasso keeps few of them.

A random forest of shallow trees is fitted to labelled documents. Every node below a root is a conjunctive rule over the statistics; a logistic
regression with an L1 penalty, chosen on a fold of the learning rows, weighs the rules. What is left is one Spark column expression over the
statistics, which one narrow Arrow pass over the texts counts (``text_statistics``).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tierflow.llm.common import doc_rows
from tierflow.llm.text_statistics import CLASSES, MATCHES, STATISTICS, with_statistics
from tierflow.llm.toxicity import held_out
from tierflow.operators.scale import staged

SAMPLE = 10_000  # labelled documents that a fit reads, about
TREES, DEPTH = 30, 3
PENALTIES = (3e-4, 1e-3, 3e-3)
STEPS, SWEEPS = 40, 200  # of a fit, and of one of its steps, at most
FOLD = 4  # one learning row in so many chooses the penalty
SCORE_AT_LEAST = 0.3


@dataclass(frozen=True)
class Rule:
    """Holds where every named statistic is above its lower and at most its upper bound."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self, of: Column) -> Column:
        """The rule over a struct of statistics."""
        tests = [of[k] > low for k, low, _ in self.bounds if low > -math.inf] + [of[k] <= high for k, _, high in self.bounds if high < math.inf]
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join(f"{low:.6g} < {k} <= {high:.6g}" for k, low, high in self.bounds)


_TEST = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(forest: str, names: list[str]) -> list[Rule]:
    """The distinct conjunctions on the paths of a printed forest."""
    path: list[tuple[int, str, str, float]] = []
    out: dict[Rule, None] = {}
    for line in forest.splitlines():
        m = _TEST.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[3])], m[4], float(m[5]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, value in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (max(low, value), high) if sign == ">" else (low, min(high, value))
        out[Rule(tuple((k, *v) for k, v in sorted(bounds.items())))] = None
    return list(out)


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def judge(self, of: Column) -> Column:
        """A struct of the score and the numbers of the rules that hold, as an expression over a struct of statistics."""
        total, fired = F.lit(self.bias), F.array().cast("array<int>")
        for r in self.rules:
            total = total + F.when(r.column(of), F.lit(r.weight)).otherwise(0.0)
        if self.rules:
            fired = F.array_compact(F.array(*[F.when(r.column(of), F.lit(i)) for i, r in enumerate(self.rules)]))
        return F.struct((1.0 / (1.0 + F.exp(-total))).alias("score"), fired.alias("rules"))


def _objective(z, y, w, b, penalty) -> float:
    m = b + z @ w
    return float(np.mean(np.logaddexp(0.0, m) - y * m) + penalty * np.abs(w).sum())


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression with the least mean log loss plus ``penalty`` times the sum of the weights' sizes, each
    times its column's deviation. Newton steps; each one's quadratic form is solved by coordinate descent, and halved until the objective falls."""
    spread = x.std(0)
    varies = spread > 0
    z, n = x[:, varies] / spread[varies], len(y)
    w, b = np.zeros(z.shape[1]), math.log((y.sum() + .5) / (n - y.sum() + .5))
    now = _objective(z, y, w, b, penalty)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(b + z @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-5)
        slope, slope0 = z.T @ (p - y) / n, float((p - y).mean())
        curve, curve0, cross = z.T @ (z * v[:, None]) / n, float(v.mean()), z.T @ v / n
        after, after0 = w.copy(), b
        for _ in range(SWEEPS):
            moved = 0.0
            for j in range(len(after)):
                a = curve[j, j]
                t = after[j] - slope[j] / a
                t = math.copysign(max(abs(t) - penalty / a, 0.0), t)
                d = t - after[j]
                if d:
                    after[j] = t
                    slope += curve[j] * d
                    slope0 += cross[j] * d
                    moved = max(moved, abs(d))
            d = -slope0 / curve0
            after0 += d
            slope, slope0 = slope + cross * d, 0.0
            if max(moved, abs(d)) < 1e-6:
                break
        share = 1.0
        while share > 1e-3 and (found := _objective(z, y, w + share * (after - w), b + share * (after0 - b), penalty)) > now:
            share /= 2
        if share <= 1e-3 or now - found < 1e-9:
            break
        w, b, now = w + share * (after - w), b + share * (after0 - b), found
    out = np.zeros(x.shape[1])
    out[varies] = w / spread[varies]
    return b, out


def best_lasso(x: np.ndarray, y: np.ndarray, chooses: np.ndarray, penalties) -> tuple[float, np.ndarray]:
    """The fit to all rows with the penalty whose fit to the others loses least on the rows that choose; of equal ones the largest."""
    def loss(penalty):
        b, w = lasso(x[~chooses], y[~chooses], penalty)
        return _objective(x[chooses], y[chooses], w, b, 0.0)

    own = y[~chooses]
    tried = {p: loss(p) for p in penalties} if chooses.any() and 0 < own.sum() < len(own) else dict.fromkeys(penalties, 0.0)
    return lasso(x, y, min(penalties, key=lambda p: (tried[p], -p)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalties=PENALTIES) -> Ensemble:
    """Fits on about ``sample`` labelled documents outside the held-out fold, picked by a hash of doc_id."""
    own = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label")))
    share = min(1.0, sample / max(1, own.count()))
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the ids picked are about ``sample`` in number, whatever the size of the tables
    rows = with_statistics(doc_rows(docs).join(F.broadcast(picked), "doc_id").select("doc_id", F.col("label").cast("double").alias("label"), "text"))
    names = list(STATISTICS)
    # the same partitions in the same order whatever files the rows came from, so that a fit can be repeated
    learnt = staged(rows.select("doc_id", "label", "s.*")).repartition(4, "doc_id").sortWithinPartitions("doc_id", *names)
    shares = learnt.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, ones = shares[0], shares[1] or 0.0
    if not 0 < ones < n:
        return Ensemble(0.0 if not n else 30.0 if ones else -30.0, ())
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(learnt)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=.7, seed=7).fit(wide)
    rules = rules_of(forest.toDebugString, names)
    if not rules:
        return Ensemble(math.log(ones / (n - ones)), ())
    own = F.struct(*names)
    held = learnt.select("doc_id", "label", (F.col("doc_id") * 0).alias("all"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLD)) == 0).alias("chooses"),
                         F.array(*[r.column(own).cast("tinyint") for r in rules]).alias("holds"))

    def fit(rows):
        x = rows["holds"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        order = np.lexsort((*np.packbits(x, axis=1).T, rows["doc_id"].to_numpy()))  # the same sums whatever order the rows come in
        bias, weights = best_lasso(x[order].astype(float), rows["label"].to_numpy()[order], rows["chooses"].to_numpy()[order], penalties)
        return pa.table({"bias": [bias], "weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})

    # ``sample`` rows, so one task
    model = held.groupBy("all").applyInArrow(fit, "bias double, weights array<double>").first()
    return Ensemble(model["bias"], tuple(Rule(r.bounds, w) for r, w in zip(rules, model["weights"]) if w))


def score(docs: DataFrame, labels: DataFrame, at_least: float = SCORE_AT_LEAST, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, rules (numbers of those that hold), one row per row of ``docs``.

    Every whole text is scored; labels are learnt from documents whose crc32(doc_id) mod 5 is not 0, and only the text's statistics are inputs. A null
    text is an empty one, whose statistics are 0; a null doc_id is not held out; repeated rows are scored each; labels that are null
    or not 0/1 are skipped, of repeated ones the larger is taken; with labels of one kind all scores are near that label, with none they are 0.5; an
    empty table gives no rows; other columns are ignored.
    """
    return judged(docs, train(docs, labels, sample), at_least)


def judged(docs: DataFrame, model: Ensemble, at_least: float = SCORE_AT_LEAST) -> DataFrame:
    out = with_statistics(doc_rows(docs)).select("doc_id", model.judge(F.col("s")).alias("j"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "j.score", (F.col("j.score") >= at_least).cast("int").alias("predicted"), "j.rules")

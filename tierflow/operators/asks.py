"""Vote fatigue: every ask lowers the rate of the agent's later ones, so rows are decided one after another.

What a row does depends on the number of earlier asks alone, and as the rate only falls, there is a number below which it asks. A run
of rows is therefore a function from the count before it to the count after it, and its values up to the count at which the rate
stops falling tell it whole. Runs are ranges of (agent, time, id) of about equal size, whatever share of the log one agent or one hour
holds: each run gives its function, an agent's functions are applied one after another to find the count at the start of every run, and
then all runs decide on their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tierflow.operators.scale import staged, unit_hash

BASE, FLOOR, CAP, FATIGUE = 0.10, 0.02, 0.5, 50.0
WEAK, WEAK_FACTOR = ("moderate", "heavy", "intensive"), 2.0


def ask_rate(asked: Column, tier: Column, base: float = BASE, weak=WEAK, weak_factor: float = WEAK_FACTOR) -> Column:
    """Vote rate after ``asked`` earlier asks."""
    rate = F.greatest(F.lit(FLOOR), F.exp(-asked / FATIGUE) * base)
    return F.least(F.lit(CAP), F.when(tier.isin(list(weak)), rate * weak_factor).otherwise(rate))


def falling_rates(base: float = BASE) -> list[float]:
    """Rate after 0, 1, 2, ... asks, down to the first that no longer falls."""
    out = [max(FLOOR, base)]
    while out[-1] > FLOOR:
        out.append(max(FLOOR, math.exp(-len(out) / FATIGUE) * base))
    return out


def _patience(u: Column, tier: Column, confidence: Column, rates: list[float], always_below: float, never, weak, weak_factor) -> Column:
    """The number of earlier asks from which on the row doesn't ask; ``len(rates)`` where it always asks."""
    factor = F.when(tier.isin(list(weak)), F.lit(weak_factor)).otherwise(F.lit(1.0))
    by_rate = F.size(F.filter(F.array(*[F.lit(r) for r in rates]), lambda r: u < F.least(F.lit(CAP), r * factor)))
    return F.when(tier.isin(list(never)), 0).when(confidence < always_below, len(rates)).otherwise(by_rate)


def run_function(patience: np.ndarray, levels: int) -> np.ndarray:
    """Count after the run for every count 0 .. levels - 1 before it; beyond those it grows by as much as for the last."""
    count = np.arange(levels)
    for i, p in enumerate(patience):
        if count[0] >= levels - 1:  # the smallest: from here on only rows that always ask count
            return count + int((patience[i:] >= levels).sum())
        count += (count < p) | (p >= levels)
    return count


def apply_function(counts, before: int) -> int:
    last = len(counts) - 1
    return int(counts[before] if before <= last else counts[last] + before - last)


def run_decisions(patience: np.ndarray, before: int, levels: int) -> np.ndarray:
    """Which rows of a run ask, after ``before`` earlier asks."""
    asked = patience >= levels
    for i in np.flatnonzero(patience):
        if before >= levels - 1:
            break
        asked[i] = asked[i] or before < patience[i]
        before += int(asked[i])
    return asked


def _in_order(rows: pa.Table, order: list[str]) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))


def with_asks(df: DataFrame, seed: int = 42, base: float = BASE, always_below: float = 0.5, never=("trivial", "extreme"), weak=WEAK,
              weak_factor: float = WEAK_FACTOR, key: str = "interaction_id", ts: str = "ts", agent: str = "agent_id",
              tier: str = "predicted_tier", confidence: str = "confidence") -> DataFrame:
    """Adds ``prior_asks``, the agent's asks before the row, and ``asked``.

    A row of a ``never`` tier doesn't ask; one less sure than ``always_below`` does; else the row's seeded number decides against
    ``ask_rate(prior_asks)``. Rows go by (ts, key), nulls first; rows equal in both are decided in any order. Null agents are one agent; a null
    tier is neither weak nor excluded; a null confidence leaves it to the rate; an empty table gives no rows. Columns named as the two new
    ones are replaced.
    """
    spark = df.sparkSession
    rates = falling_rates(base)
    levels = len(rates)
    kept = [c for c in df.columns if c not in ("prior_asks", "asked")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    patience = _patience(unit_hash(F.col(key), seed), F.col(tier), F.col(confidence), rates, always_below, never, weak, weak_factor)
    rows = staged(df.select(*kept).withColumn("__patience", patience).repartitionByRange(n, agent, ts, key)
                  .withColumn("__run", F.spark_partition_id()))
    of = f"`{agent}` {df.schema[agent].dataType.simpleString()}, __run int"
    order = [ts, key]

    def function(ids, group):
        counts = run_function(_in_order(group, order)["__patience"].to_numpy(), levels)
        return pa.table([pa.array([ids[0].as_py()], ids[0].type), pa.array([ids[1].as_py()], pa.int32()),
                         pa.array([counts.tolist()], pa.list_(pa.int64()))], names=[agent, "__run", "__counts"])

    functions = rows.select(agent, "__run", ts, key, "__patience").groupBy(agent, "__run").applyInArrow(function, f"{of}, __counts array<bigint>")

    def starts(group):
        group = group.sort_by("__run")
        before, out = 0, []
        for counts in group["__counts"]:
            out.append(before)
            before = apply_function(counts.as_py(), before)
        return group.select([agent, "__run"]).append_column("__start", pa.array(out, pa.int64()))

    begun = functions.groupBy(agent).applyInArrow(starts, f"{of}, __start bigint")

    def decide(group, start):
        group = _in_order(group, order)
        before = start["__start"][0].as_py()
        asked = run_decisions(group["__patience"].to_numpy(), before, levels)
        prior = before + np.cumsum(asked) - asked
        return group.select(kept).append_column("prior_asks", pa.array(prior, pa.int64())).append_column("asked", pa.array(asked, pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return rows.groupBy(agent, "__run").cogroup(begun.groupBy(agent, "__run")).applyInArrow(decide, f"{fields}, prior_asks bigint, asked boolean")


def sample_for_votes(df: DataFrame, **options) -> DataFrame:
    """Rows whose user is asked; ``options`` as for ``with_asks``."""
    return with_asks(df, **options).where("asked").drop("prior_asks", "asked")

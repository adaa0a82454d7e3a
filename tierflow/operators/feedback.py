"""Feedback, vote and cost-log analytics.

Every total is a partial plus final aggregate. Ordered per-agent work goes through
``scale.running`` or halo chunks, because one agent may hold a third of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S, text as T
from tierflow.functions.num import rnd
from tierflow.operators.scale import (RANGE, dimension, in_ranges, running, staged, time_bucket, top_per_key,
                                      unit_hash, with_halo)


# --- reads ----------------------------------------------------------------------
def feedback_records(df: DataFrame, since=None, limit: int | None = None, ts: str = "ts",
                     tie: str = "interaction_id") -> DataFrame:
    """Newest records first, ``limit`` of them if given."""
    d = df if since is None else df.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    d = d.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return d if limit is None else d.limit(limit)


def keep_latest(df: DataFrame, n: int, ts: str = "ts", tie: str = "interaction_id",
                keys: list[str] | None = None) -> DataFrame:
    """Newest n rows, over all rows or per key."""
    order = [F.col(ts).desc(), F.col(tie).desc()]
    if keys:
        return top_per_key(df, keys, order, n).drop("rank")
    return df.orderBy(*order).limit(n)


def drop_expired_votes(votes: DataFrame, now) -> DataFrame:
    return votes.where((F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
                       | F.col("actual_tier").isNotNull())


def drop_expired_entries(index: DataFrame, now, ttl: int, created: str = "created") -> DataFrame:
    """Entries younger than ttl, in the unit of ``created``."""
    return index.where(F.lit(now) - F.col(created) < ttl)


def purge(df: DataFrame, now, keep_days: int = 90, ts: str = "ts") -> DataFrame:
    """Rows inside the retention period; on a date-partitioned log this prunes partitions."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(keep_days))
    return df.where(F.col(ts) >= cutoff)


def votes(df: DataFrame, agent=None, source=None, tier=None) -> DataFrame:
    for col, value in (("agent_id", agent), ("source", source), ("predicted_tier", tier)):
        if value is not None:
            df = df.where(F.col(col) == value)
    return df


def labelled_votes(df: DataFrame, now, min_weight: float = 0.0, agent=None) -> DataFrame:
    return votes(df, agent).where(F.col("actual_tier").isNotNull()
                                  & (F.col("asked_at") < F.lit(now).cast("timestamp_ntz"))
                                  & (F.col("weight") >= min_weight))


# --- classifier and routing reports ----------------------------------------------
def confusion(df: DataFrame, predicted: str = "predicted_tier", actual: str = "actual_tier",
              weight: str | None = None) -> DataFrame:
    """Counts per label pair; ``weight`` names a count column of pre-aggregated rows."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(F.coalesce(F.col(actual), F.lit("moderate")).alias("actual"),
                      F.col(predicted).alias("predicted")).agg(n.alias("n"))


def confusion_matrix(df: DataFrame, predicted: str = "predicted_tier", actual: str = "actual_tier") -> DataFrame:
    c = confusion(df, predicted, actual)
    return c.groupBy("actual").pivot("predicted", V.TIERS).agg(F.sum("n")).na.fill(0, V.TIERS)


def evaluate(df: DataFrame, predicted: str = "predicted_tier", actual: str = "actual_tier",
             weight: str | None = None) -> DataFrame:
    """One row per tier (null accuracy when it has no rows), then ``overall`` and ``macro``.
    One pass over the rows; everything after the confusion counts is at most 36 rows."""
    c = confusion(df, predicted, actual, weight)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_tier = c.groupBy("actual").agg(F.sum("n").alias("total"), hit.alias("correct"),
                                      F.collect_set("predicted").alias("preds"))
    one = by_tier.agg(
        F.map_from_entries(F.collect_list(F.struct("actual", F.struct("total", "correct")))).alias("m"),
        F.sum("total").alias("total"), F.sum("correct").alias("correct"),
        F.avg(F.col("correct") / F.col("total")).alias("macro"), F.count(F.lit(1)).alias("na"),
        F.size(F.array_distinct(F.flatten(F.collect_list("preds")))).alias("np"))
    zero = F.lit(0).cast("long")

    def row(tier, total, correct, accuracy):
        return F.struct(tier.alias("tier"), total.alias("total"), correct.alias("correct"),
                        accuracy.alias("accuracy"))

    def per_tier(t):
        n, k = F.col("m")[t]["total"], F.col("m")[t]["correct"]
        return row(t, F.coalesce(n, zero), F.coalesce(k, zero), rnd(k / n, 4))
    acc = F.col("correct") / F.col("total")
    macro = F.when((F.col("na") > 1) & (F.col("np") > 1), F.col("macro")).otherwise(acc)
    whole = F.array(row(F.lit("overall"), F.col("total"), F.col("correct"), rnd(acc, 4)),
                    row(F.lit("macro"), F.col("total"), F.col("correct"), rnd(macro, 4)))
    return one.select(F.explode(F.concat(F.transform(S.tier_array(), per_tier), whole)).alias("r")).select("r.*")


def tier_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy by predicted tier over judged rows."""
    return (df.where(F.col("actual_tier").isNotNull()).groupBy(F.col("predicted_tier").alias("tier"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.sum((F.col("predicted_tier") == F.col("actual_tier")).cast("long")).alias("correct"))
            .withColumn("accuracy", F.col("correct") / F.col("total")))


def routing_metrics(df: DataFrame, since=None, ts: str = "ts") -> DataFrame:
    """Overall row and one per predicted tier. Expects actual_tier, self_rating, cost_actual,
    cost_predicted, was_overkill, was_underkill."""
    d = df if since is None else df.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    flag = lambda c: F.sum(F.col(c).cast("long"))
    part = d.groupBy("predicted_tier").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("predicted_tier") == F.col("actual_tier")).cast("long")).alias("correct"),
        flag("was_overkill").alias("over"), flag("was_underkill").alias("under"),
        F.sum("self_rating").alias("rating"), F.sum("cost_actual").alias("cost"),
        F.sum("cost_predicted").alias("predicted"))
    sums = [F.sum(c).alias(c) for c in ["total", "correct", "over", "under", "rating", "cost", "predicted"]]
    both = part.withColumnRenamed("predicted_tier", "tier").unionByName(
        part.agg(*sums).withColumn("tier", F.lit("overall")))
    t = F.col("total")
    return both.where(t > 0).select(
        "tier", "total", rnd(F.col("correct") / t, 3).alias("accuracy"),
        rnd(F.col("over") / t, 3).alias("overkill_rate"), rnd(F.col("under") / t, 3).alias("underkill_rate"),
        rnd(F.col("rating") / t, 3).alias("avg_self_rating"), rnd("cost", 4).alias("total_cost"),
        rnd("predicted", 4).alias("predicted_cost"),
        rnd(F.when(F.col("predicted") > 0, (1 - F.col("cost") / F.col("predicted")) * 100).otherwise(0.0), 1)
        .alias("cost_savings_pct"))


def compare_tiers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ``evaluate`` results side by side, tiers with rows only."""
    x = a.where(F.col("tier").isin(V.TIERS)).select(
        "tier", F.col("accuracy").alias("baseline"), F.col("correct").alias("baseline_correct"), "total")
    y = b.where(F.col("tier").isin(V.TIERS)).select(
        "tier", F.col("accuracy").alias("cascade"), F.col("correct").alias("cascade_correct"))
    return (x.join(y, "tier").where(F.col("baseline").isNotNull() & F.col("cascade").isNotNull())
            .withColumn("delta", rnd(F.col("cascade") - F.col("baseline"), 4)))


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per label pair, with the overall agreement rate on each row."""
    c = df.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # at most 36 rows
    same = F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)
    return c.withColumn("agreement", F.sum(same).over(w) / F.sum("n").over(w))


# --- cost log ---------------------------------------------------------------------
def daily_summary(costs: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per day with totals and the tier and model counts as maps."""
    d = costs.withColumn("date", F.date_format(ts, "yyyy-MM-dd"))
    part = d.groupBy("date", F.col("predicted_tier").alias("tier"), "routed_model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("ti"), F.sum("tokens_out").alias("to"),
        F.sum("cost_usd").alias("cost"), F.sum("baseline_cost_usd").alias("base"))
    total = part.groupBy("date").agg(
        F.sum("n").alias("total_requests"), F.sum("ti").alias("total_tokens_in"),
        F.sum("to").alias("total_tokens_out"), F.sum("cost").alias("total_cost_usd"),
        F.sum("base").alias("baseline_cost_usd"))

    def counts(key, name):
        return (part.groupBy("date", key).agg(F.sum("n").alias("n")).groupBy("date")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name)))
    out = total.join(counts("tier", "tier_distribution"), "date").join(
        counts("routed_model", "model_distribution"), "date")
    saved = F.col("baseline_cost_usd") - F.col("total_cost_usd")
    return (out.withColumn("total_savings_usd", saved)
            .withColumn("savings_pct", F.when(F.col("baseline_cost_usd") > 0,
                        saved / F.col("baseline_cost_usd") * 100).otherwise(0.0)))


def cost_projection(summary: DataFrame) -> DataFrame:
    return summary.select(
        "date", (F.col("total_cost_usd") * 30).alias("monthly_cost"),
        (F.col("total_savings_usd") * 30).alias("monthly_savings"),
        (F.col("total_savings_usd") * 365).alias("annual_savings"),
        F.transform_values("tier_distribution",
                           lambda k, v: v / F.col("total_requests") * 100).alias("tier_shares"))


def agent_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.max("ts").alias("last_used"))


def log_kpis(df: DataFrame, local: Column, expected: str = "actual_tier", score: str = "score") -> DataFrame:
    n = F.count(F.lit(1))
    share = F.sum(local.cast("long")) / n
    known = F.col(expected).isNotNull()
    right = F.sum((known & (F.col(expected) == F.col("predicted_tier"))).cast("long"))
    mean = lambda t: F.coalesce(F.avg(F.when(F.col("predicted_tier") == t, F.col(score))), F.lit(0.0))
    pct = F.floor(share * 100 + 0.5)
    counts = [F.sum((F.col("predicted_tier") == t).cast("long")).alias(f"n_{t}") for t in V.TIERS]
    return df.agg(
        n.alias("queries"), F.floor(F.avg("latency_ms") + 0.5).cast("long").alias("mean_latency_ms"),
        pct.cast("long").alias("local_pct"),
        (n * 200 / 1e6 * 2.5 * (pct / 100.0)).alias("estimated_savings"),
        F.floor(right / F.sum(known.cast("long")) * 100 + 0.5).cast("long").alias("accuracy_pct"),
        mean("trivial").alias("mean_trivial"), mean("extreme").alias("mean_extreme"),
        (mean("extreme") - mean("trivial")).alias("delta"), *counts)


def mix_projection(shares: DataFrame, volume: int, unit_costs=V.UNIT_COSTS,
                   baseline: float = V.BASELINE_UNIT_COST) -> DataFrame:
    """Share of each tier times volume and unit cost, per day and month, and the total
    against sending everything to one model."""
    costs = dimension(shares.sparkSession, ["tier", "unit_cost"], unit_costs)
    d = (shares.join(F.broadcast(costs), "tier")
         .withColumn("messages", F.col("share") * volume)
         .withColumn("daily_cost", F.col("messages") * F.col("unit_cost"))
         .withColumn("monthly_cost", F.col("daily_cost") * 30))
    cols = ["tier", "messages", "daily_cost", "monthly_cost", "savings_pct"]
    total = d.agg(F.sum("messages").alias("messages"), F.sum("daily_cost").alias("daily_cost"),
                  F.sum("monthly_cost").alias("monthly_cost")).withColumn("tier", F.lit("total")) \
        .withColumn("savings_pct", (1 - F.col("daily_cost") / (F.col("messages") * baseline)) * 100)
    return d.withColumn("savings_pct", F.lit(None).cast("double")).select(*cols).unionByName(total.select(*cols))


def monitor_alerts(costs: DataFrame) -> DataFrame:
    """Accuracy per tier, cost per message and escalation rate against their alert bounds.
    Expects predicted_tier, actual_tier, cost_usd and escalated."""
    part = costs.groupBy("predicted_tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost"),
        F.sum(F.col("escalated").cast("long")).alias("esc"),
        F.sum(F.col("actual_tier").isNotNull().cast("long")).alias("judged"),
        F.sum(F.coalesce((F.col("predicted_tier") == F.col("actual_tier")).cast("long"), F.lit(0))).alias("ok"))
    spark = costs.sparkSession
    bounds = dimension(spark, ["predicted_tier", "bound"], V.ACCURACY_ALERTS)
    per = part.join(F.broadcast(bounds), "predicted_tier").where("judged > 0").select(
        F.concat(F.col("predicted_tier"), F.lit(" accuracy")).alias("metric"),
        (F.col("ok") / F.col("judged")).alias("value"), "bound",
        (F.col("ok") / F.col("judged") < F.col("bound")).alias("alert"))
    tot = part.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("esc").alias("esc"))
    rest = tot.select(F.explode(F.array(
        F.struct(F.lit("cost per message").alias("metric"), (F.col("cost") / F.col("n")).alias("value"),
                 F.lit(V.COST_ALERT).alias("bound"), (F.col("cost") / F.col("n") > V.COST_ALERT).alias("alert")),
        F.struct(F.lit("escalation rate").alias("metric"), (F.col("esc") / F.col("n")).alias("value"),
                 F.lit(V.ESCALATION_ALERT).alias("bound"),
                 (F.col("esc") / F.col("n") > V.ESCALATION_ALERT).alias("alert")))).alias("r")).select("r.*")
    return per.unionByName(rest)


def over_ceiling(costs: DataFrame, ceilings=V.MAX_COST_PER_MESSAGE) -> DataFrame:
    """Rows that cost more than their tier allows."""
    c = dimension(costs.sparkSession, ["predicted_tier", "ceiling"], ceilings)
    return costs.join(F.broadcast(c), "predicted_tier").where(F.col("cost_usd") > F.col("ceiling"))


def index_stats(index: DataFrame, now, ttl: int, created: str = "created") -> DataFrame:
    live = F.lit(now) - F.col(created) < ttl
    mean = F.coalesce(F.avg(F.when(live, F.col("compressed_tokens"))), F.lit(0.0))
    return index.agg(F.count(F.lit(1)).alias("total"), F.sum(live.cast("long")).alias("active"),
                     F.floor(mean + 0.5).cast("long").alias("avg_tokens"))


def store_composition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("predicted_tier").alias("tier")).agg(
        F.count(F.lit(1)).alias("entries"), F.count("actual_tier").alias("judged"))


def _sliced(df: DataFrame, keys: list[str], order: list[str], slice_seconds: int | None,
            added: dict[str, Column] | None = None) -> tuple[DataFrame, Column]:
    """The rows and the bucket for ``running``: ranges of rows, or time slices of a given width. ``added`` are more columns."""
    if slice_seconds is None:
        return in_ranges(df, keys, order, added=added), F.col(RANGE)
    return df.withColumns(added or {}), time_bucket(F.col(order[0]), slice_seconds)


# --- votes -------------------------------------------------------------------------
def match_votes(replies: DataFrame, requests: DataFrame, within_seconds: int = 300,
                slice_seconds: int | None = None) -> DataFrame:
    """Each vote reply takes the newest request of its agent that is still unanswered and
    younger than the limit.

    Requests open and replies close, newest first, which is bracket matching; no pairs are
    enumerated. Hot agents and hours are cut into ranges of rows, or into time slices where
    ``slice_seconds`` is given. Inside a range a running level per agent pairs each reply with
    the last request on its level. What a range leaves over is replies and then requests, so the
    two counts of every range give the levels of all rows left over, and no level has more than
    two of them in a range. Rows left over that are too old for any other range are dropped
    first: whatever takes their place is older still. Rows without agent or time match nothing.
    """
    agreed, tier = T.parse_vote_reply(F.col("reply_text"))
    opened = requests.select("agent_id", F.col("asked_at").alias("t"), F.lit(0).alias("kind"),
                             F.col("request_id").alias("id"), "predicted_tier", F.lit(None).cast("string").alias("reply_text"))
    closed = replies.select("agent_id", F.col("replied_at").alias("t"), F.lit(1).alias("kind"),
                            F.col("reply_id").alias("id"), F.lit(None).cast("string").alias("predicted_tier"), "reply_text")
    order, run, asks = ["t", "kind", "id"], ["agent_id", RANGE], F.col("kind") == 0
    within = F.make_dt_interval(secs=F.lit(within_seconds).cast("decimal(18,6)"))
    ev, slot = _sliced(opened.unionByName(closed).where("agent_id is not null and t is not null"), ["agent_id"], order, slice_seconds,
                       {"agreed": agreed, "correct_tier": tier})
    step, local, whole = F.when(asks, 1).otherwise(-1), Window.partitionBy(*run).orderBy(*order), Window.partitionBy(*run)
    ev = ev.withColumn(RANGE, slot).where(asks | F.col("agreed").isNotNull()).withColumn("s", F.sum(step).over(_upto(local)))
    low = F.least(F.lit(0), F.min("s").over(local.rowsBetween(Window.unboundedPreceding, -1)))
    ev = ev.withColumn("level", F.col("s") - low + F.when(asks, 0).otherwise(1))
    ev = ev.withColumn("first", F.min("t").over(whole)).withColumn("last", F.max("t").over(whole)).withColumn(
        "end", F.sum(step).over(whole) - F.least(F.lit(0), F.min("s").over(whole)))
    ev = _with_asked(ev, [*run, "level"], order)
    left = F.when(asks, F.col("next").isNull() & (F.col("last") < F.col("t") + within)).otherwise(
        (F.col("level") == 0) & (F.col("t") < F.col("first") + within))
    place = F.when(asks, F.col("end") - F.col("level") + 1).otherwise(-F.col("s"))
    hit = ~asks & (F.col("level") > 0) & (F.col("t") < F.col("asked.t") + within)
    ev = staged(ev.withColumn("left", left).where(F.col("left") | hit).select(
        *run, *order, "predicted_tier", "agreed", "correct_tier", "asked", "left", place.alias("place")))
    rest = ev.where("left").drop("asked")
    ranges = Window.partitionBy("agent_id").orderBy(RANGE)
    levels = rest.groupBy(*run).agg(F.sum(F.when(asks, 1).otherwise(0)).alias("opens"), F.sum(F.when(asks, 1).otherwise(-1)).alias("n"))
    levels = levels.withColumn("s", F.sum("n").over(_upto(ranges)))
    levels = levels.withColumn("after", F.col("s") - F.least(F.lit(0), F.min(F.col("s") - F.col("opens")).over(_upto(ranges))))
    levels = levels.select(*run, "after", F.lag("after", 1, 0).over(ranges).alias("before"))
    rest = rest.join(levels, run).withColumn("level", F.when(asks, F.col("after")).otherwise(F.col("before")) - F.col("place") + 1)
    rest = _with_asked(rest.where("level > 0"), ["agent_id", "level"], order)
    out = [F.col("id").alias("reply_id"), "agent_id", F.col("asked.id").alias("request_id"),
           F.col("asked.predicted_tier").alias("predicted_tier"), "agreed", "correct_tier"]
    return ev.where("not left").select(*out).unionByName(rest.where(~asks & (F.col("t") < F.col("asked.t") + within)).select(*out))


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with_asked(ev: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``asked``, the row before on the same level, and ``next``, the kind of the row after. Requests and replies take turns on a level."""
    level = Window.partitionBy(*keys).orderBy(*order)
    return ev.withColumn("asked", F.lag(F.struct("t", "id", "predicted_tier")).over(level)).withColumn("next", F.lead("kind").over(level))


def apply_votes(matched: DataFrame) -> DataFrame:
    """Actual tier and correctness of answered requests. A bare "no" keeps the predicted
    tier, yet counts as wrong."""
    actual = F.when(F.col("agreed"), F.col("predicted_tier")).otherwise(
        F.coalesce("correct_tier", "predicted_tier"))
    right = F.col("agreed") | F.coalesce(F.col("correct_tier") == F.col("predicted_tier"), F.lit(False))
    return matched.withColumn("actual_tier", actual).withColumn("is_correct", right)


def latest_judgements(judged: DataFrame, key: str = "interaction_id", ts: str = "judged_at") -> DataFrame:
    rest = [c for c in judged.columns if c not in (key, ts)]
    return judged.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("j")).select(key, "j.*")


def merge_judgements(df: DataFrame, judged: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Newest judgement per interaction replaces adequacy and actual tier; nothing is
    updated in place."""
    j = latest_judgements(judged, key).select(
        F.col(key).alias("__k"), F.col("adequacy").alias("__a"), F.col("actual_tier").alias("__t"),
        F.lit(True).alias("__hit"))
    return (df.join(j, F.col(key) == F.col("__k"), "left")
            .withColumn("adequacy", F.when(F.col("__hit"), F.col("__a")).otherwise(F.col("adequacy")))
            .withColumn("actual_tier", F.when(F.col("__hit"), F.col("__t")).otherwise(F.col("actual_tier")))
            .drop("__k", "__a", "__t", "__hit"))


def apply_judgements(df: DataFrame, judged: DataFrame, key: str = "id", quick: str = "quick") -> DataFrame:
    """Clamped judge score, valid judged tier only, escalation from the judge if there is one."""
    j = judged.select(F.col(key).alias("__k"), F.col("adequacy").alias("__a"), F.col("correct_tier").alias("__t"))
    d = df.join(j, F.col(key) == F.col("__k"), "left")
    score = F.when(F.col("__a") >= 0, S.clamp(F.col("__a")))
    return (d.withColumn("judge_score", score)
            .withColumn("judged_tier", F.when(F.col("judge_score").isNotNull() & F.col("__t").isin(V.TIERS),
                                              F.col("__t")))
            .withColumn("should_escalate", F.coalesce(F.col("judge_score") < 0.6, F.col(quick) < 0.5))
            .drop("__k", "__a", "__t"))


def training_stats(votes_df: DataFrame, now, base_enabled: bool = True) -> DataFrame:
    """Per agent: votes, right votes, pending requests, labels by source, fatigue, accuracy."""
    at = F.lit(now).cast("timestamp_ntz")
    labelled = F.col("actual_tier").isNotNull() & (F.col("asked_at") < at)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    gold = labelled & (F.col("source") == "gold")
    right = F.col("agreed") | (F.col("correct_tier") == F.col("predicted_tier"))
    fresh = ~F.col("voted") & (F.col("expires_at") > at) & (F.col("asked_at") <= at)
    d = votes_df.groupBy("agent_id").agg(
        n(gold).alias("total_votes"), n(gold & right).alias("correct_votes"),
        F.count(F.lit(1)).alias("total_requests"), n(fresh).alias("pending_votes"),
        n(labelled & (F.col("source") == "silver")).alias("silver_labels"),
        n(labelled & (F.col("source") == "bronze")).alias("bronze_labels"),
        n(F.col("voted")).alias("n_voted"), n(F.col("voted") & right).alias("n_right"))
    return (d.withColumn("fatigue", F.exp(-F.col("total_requests") / 50.0))
            .withColumn("overall_accuracy", F.when(F.col("n_voted") > 0, F.col("n_right") / F.col("n_voted"))
                        .otherwise(-1.0)).drop("n_voted", "n_right"))


def agent_tier_accuracy(votes_df: DataFrame) -> DataFrame:
    """Right and total answered votes for every agent and tier; accuracy -1 without votes."""
    right = F.coalesce(F.col("agreed") | (F.col("correct_tier") == F.col("predicted_tier")), F.lit(False))
    got = votes_df.groupBy("agent_id", F.col("predicted_tier").alias("tier")).agg(
        F.sum(F.col("voted").cast("long")).alias("total"),
        F.sum((F.col("voted") & right).cast("long")).alias("correct"))
    every = got.select("agent_id").distinct().select(
        "agent_id", F.explode(S.tier_array()).alias("tier"))
    return (every.join(got, ["agent_id", "tier"], "left").na.fill(0, ["total", "correct"])
            .withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(-1.0)))


def retrain_gate(votes_df: DataFrame, now, after_votes: int = 10) -> DataFrame:
    """Enough gold votes with two tiers of three or more, or 100 labels of any source."""
    lab = labelled_votes(votes_df, now, 0.5)
    by_tier = lab.groupBy("agent_id", "predicted_tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("source") == "gold").cast("long")).alias("gold"))
    d = by_tier.groupBy("agent_id").agg(
        F.sum("n").alias("labelled"), F.sum("gold").alias("gold_votes"),
        F.sum((F.col("gold") >= 3).cast("long")).alias("tiers_with_min"))
    return d.withColumn("retrain", ((F.col("gold_votes") >= after_votes) & (F.col("tiers_with_min") >= 2))
                        | (F.col("labelled") >= 100))


def optimiser_gate(df: DataFrame, min_per_tier: int = 50, every: int = 500) -> DataFrame:
    """Gate of the ensemble search: six times the minimum in total and the minimum in every
    tier seen; plus the every-n-interactions trigger."""
    part = df.groupBy("predicted_tier").agg(F.count(F.lit(1)).alias("n"), F.count("actual_tier").alias("judged"))
    least = F.min(F.when(F.col("judged") > 0, F.col("judged")))
    return part.agg(F.sum("n").alias("interactions"), F.sum("judged").alias("judged"),
                    least.alias("least_per_tier")).select(
        "*", ((F.col("judged") >= min_per_tier * 6) & (F.col("least_per_tier") >= min_per_tier)).alias("search_due"),
        ((F.col("interactions") > 0) & (F.col("interactions") % every == 0)).alias("interval_due"))


def sample_unjudged(df: DataFrame, rate: float = 0.10, seed: int = 42, key: str = "interaction_id") -> DataFrame:
    return df.where(F.col("adequacy").isNull() & (unit_hash(F.col(key), seed) < rate))


def sample_per_tier(df: DataFrame, n: int, seed: int = 42, key: str = "interaction_id",
                    tier: str = "predicted_tier") -> DataFrame:
    return top_per_key(df.withColumn("__u", unit_hash(F.col(key), seed)), [tier],
                       [F.col("__u"), F.col(key)], n).drop("__u", "rank")


def ab_split(df: DataFrame, holdout: float = 0.10, seed: int = 42, key: str = "interaction_id") -> DataFrame:
    return df.withColumn("arm", F.when(unit_hash(F.col(key), seed) < holdout, "holdout").otherwise("new"))


def ab_report(df: DataFrame) -> DataFrame:
    judged = F.col("actual_tier").isNotNull()
    return df.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.sum(judged.cast("long")).alias("judged"),
        F.avg(F.when(judged, (F.col("predicted_tier") == F.col("actual_tier")).cast("double"))).alias("accuracy"))


# --- label sources -------------------------------------------------------------------
def combine_labels(sources: DataFrame, silver_weight: float = 0.3, bronze_weight: float = 0.5) -> DataFrame:
    """Gold wins; otherwise a weighted vote, ties to the tier seen first."""
    factor = F.when(F.col("source") == "silver", silver_weight).when(
        F.col("source") == "bronze", bronze_weight).otherwise(1.0)
    part = sources.groupBy("id", "tier").agg(
        F.sum(F.when(F.col("source") != "gold", F.col("weight") * factor)).alias("w"),
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("source") == "gold", F.col("seq"))).alias("gold_seq"))
    d = part.groupBy("id").agg(
        F.min(F.when(F.col("gold_seq").isNotNull(), F.struct("gold_seq", "tier"))).alias("g"),
        F.max(F.struct(F.coalesce(rnd("w", 9), F.lit(0.0)).alias("w"), (-F.col("seq")).alias("s"), "tier")).alias("b"),
        F.sum("w").alias("total"))
    gold = F.col("g").isNotNull()
    return d.select("id", F.when(gold, F.col("g.tier")).otherwise(F.col("b.tier")).alias("tier"),
                    F.when(gold, 1.0).when(F.col("total") > 0, F.least(F.lit(1.0), F.col("b.w") / F.col("total")))
                    .otherwise(0.0).alias("confidence"),
                    F.when(gold, 1.0).otherwise(F.coalesce("total", F.lit(0.0))).alias("total_weight"))


def calibration(df: DataFrame, bronze: Column, silver: Column, ts: str = "ts",
                tie: str = "interaction_id", slice_seconds: int | None = None) -> DataFrame:
    """State of the label-source weights after each row, in log order.

    ``bronze`` and ``silver`` say whether the source agreed, null when not compared.
    """
    order = [ts, tie]
    n = lambda c: F.when(c, 1).otherwise(0).cast("long")
    d, slot = _sliced(df.withColumn("__b", bronze).withColumn("__s", silver), [], order, slice_seconds)
    d = running(d, [], order, slot, sums={
        "bronze_compared": n(F.col("__b").isNotNull()), "bronze_agreed": n(F.col("__b")),
        "silver_compared": n(F.col("__s").isNotNull()), "silver_agreed": n(F.col("__s")),
        "interactions": F.lit(1).cast("long")})
    rate_b = F.col("bronze_agreed") / F.col("bronze_compared")
    rate_s = F.col("silver_agreed") / F.col("silver_compared")
    new = F.when(F.col("__s").isNotNull() & (F.col("silver_compared") >= 10) & (rate_s > 0.7),
                 S.clamp(rate_s * 0.3, 0.1, 0.9))
    d = running(d.withColumn("__new", new), [], order, slot, previous={"__old": F.col("__new")})
    full = F.coalesce("__new", "__old", F.lit(0.3))
    phase = F.when(F.col("interactions") < 50, "disabled").when(F.col("interactions") < 200, "low").otherwise("full")
    return (d.withColumn("bronze_weight", F.when(F.col("bronze_compared") >= 10, S.clamp(rate_b * 0.5, 0.1, 0.8))
                         .otherwise(0.5))
            .withColumn("phase", phase)
            .withColumn("silver_weight", F.when(phase == "disabled", 0.0).when(phase == "low", full * 0.5)
                        .otherwise(full))
            .drop("__b", "__s", "__new", "__old", RANGE))


def _bias(n: Column, up: Column, down: Column, low: Column) -> Column:
    raw = up * 0.02 - down * 0.02 + F.when(low / n > 0.3, 0.05).otherwise(0.0)
    return F.when((n < 5) | (up + down < 3), 0.0).otherwise(S.clamp(raw, -0.1, 0.1))


def _bias_flags(df: DataFrame) -> DataFrame:
    p, a = S.tier_index(F.col("predicted_tier")), S.tier_index(F.col("actual_tier"))
    i = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return (df.withColumn("__up", i(a > p)).withColumn("__down", i(a < p))
            .withColumn("__low", i(F.coalesce("adequacy", F.lit(0.5)) < 0.6)))


def history_bias_now(df: DataFrame, n: int = 50) -> DataFrame:
    """Bias from the newest n interactions, one row."""
    d = _bias_flags(keep_latest(df, n))
    s = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ["__up", "__down", "__low"]])
    return s.select(_bias(F.col("n"), F.col("__up"), F.col("__down"), F.col("__low")).alias("bias"))


def history_bias(df: DataFrame, n: int = 50, ts: str = "ts", tie: str = "interaction_id",
                 key: str = "agent_id", chunk: int = 8192, slice_seconds: int | None = None) -> DataFrame:
    """Bias of each row from the agent's n interactions before it."""
    d, slot = _sliced(_bias_flags(df), [key], [ts, tie], slice_seconds)
    d = running(d, [key], [ts, tie], slot, sums={"__pos": F.lit(1).cast("long")})
    d = with_halo(d, "__pos", n, chunk)
    w = Window.partitionBy(key, "__chunk").orderBy("__pos").rowsBetween(-n, -1)
    count = F.count(F.lit(1)).over(w)
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ["__up", "__down", "__low"]]
    return (d.withColumn("bias", _bias(count, *sums)).where(~F.col("__halo"))
            .drop("__pos", "__chunk", "__halo", "__up", "__down", "__low", RANGE))


def session_turns_log(df: DataFrame, key: str = "agent_id", ts: str = "ts", tie: str = "interaction_id",
                      idle_seconds: int = 3600, slice_seconds: int | None = None) -> DataFrame:
    """Numbers the sessions of a key (a gap above ``idle_seconds`` starts a new one) and
    marks the turns where the model changed inside a session."""
    order = [ts, tie]
    d, slot = _sliced(df, [key], order, slice_seconds)
    d = running(d, [key], order, slot, previous={"__prev": F.struct(F.col(ts).alias("t"), F.col("routed_model").alias("m"))})
    idle = F.make_dt_interval(secs=F.lit(idle_seconds).cast("decimal(18,6)"))
    fresh = F.col("__prev").isNull() | (F.col(ts) > F.col("__prev.t") + idle)
    d = d.withColumn("__new", fresh.cast("long"))
    d = running(d, [key], order, slot, sums={"session_no": F.col("__new")})
    note = F.concat(F.lit("[Turn: "), F.col("predicted_tier"), F.lit("→"), F.col("routed_model"), F.lit("] "),
                    F.substring("response_text", 1, 300))
    return (d.withColumn("switched", (F.col("__new") == 0) & (F.col("__prev.m") != F.col("routed_model")))
            .withColumn("turn_note", note).drop("__prev", "__new", RANGE))


def session_state(turns: DataFrame, key: str = "agent_id", ts: str = "ts", tie: str = "interaction_id",
                  keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row per session with its last tier and model, its last decisions as rows)."""
    last = F.max_by(F.struct("predicted_tier", "routed_model"), F.struct(ts, tie)).alias("l")
    state = turns.groupBy(key, "session_no").agg(
        last, F.count(F.lit(1)).alias("turns"), F.sum(F.col("switched").cast("long")).alias("switches")).select(
        key, "session_no", F.col("l.predicted_tier").alias("last_tier"),
        F.col("l.routed_model").alias("last_model"), "turns", "switches")
    d = turns.select(key, "session_no", ts, tie, F.posexplode(T.key_decisions(F.col("response_text")))
                     .alias("n", "decision"))
    order = [F.col(ts).desc(), F.col(tie).desc(), F.col("n").desc()]
    return state, top_per_key(d, [key, "session_no"], order, keep)


def feedback_samples(df: DataFrame) -> DataFrame:
    """Judged feedback as training samples."""
    return df.where(F.col("actual_tier").isNotNull()).select(
        F.concat_ws("_", F.lit("fb"), "prompt_hash", F.col("id").cast("string")).alias("sample_id"),
        F.lit("feedback-loop").alias("source"), F.col("prompt_summary").alias("text"),
        F.col("actual_tier").alias("label"), F.col("self_rating").alias("confidence"))


def evaluate_interactions(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Hash, masked summary, feedback features and fit of each interaction."""
    from tierflow.functions.features import feedback_features
    d = S.assess_response(df, response)
    d = (d.withColumn("prompt_hash", T.prompt_hash(F.col(prompt)))
         .withColumn("prompt_summary", F.substring(T.safe_summary(F.col(prompt)), 1, 200)))
    return feedback_features(d, prompt)

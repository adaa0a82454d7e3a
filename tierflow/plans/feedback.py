"""Queries over feedback, votes, costs and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S, text as T
from tierflow.functions.num import rnd
from tierflow.operators import asks as K, feedback as B, retrieval as I, routing as R
from tierflow.operators.scale import unit_hash
from tierflow.plans import prompts as P, sql as Q
from tierflow.sources import adapters as A

QUERIES, ORACLE = {}, {}
NOW = "2024-01-28 12:00:00"
SINCE = "2024-01-08 00:00:00"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


W = f"WITH {Q.INTERACTIONS}"


# --- reads ------------------------------------------------------------------------
@query("s9_feedback_records", f"""{W} SELECT interaction_id, ts, predicted_tier FROM interactions
  WHERE ts >= TIMESTAMP '{SINCE}' ORDER BY ts DESC, interaction_id DESC LIMIT 100""")
def s9(spark, sf):
    return B.feedback_records(A.interactions(spark, sf), SINCE, 100).select("interaction_id", "ts", "predicted_tier")


@query("k1_newest_first", f"""{W} SELECT interaction_id, ts FROM interactions ORDER BY ts DESC, interaction_id DESC LIMIT 25""")
def k1(spark, sf):
    return B.feedback_records(A.interactions(spark, sf), None, 25).select("interaction_id", "ts")


@query("w1_keep_latest", f"""{W} SELECT agent_id, interaction_id FROM interactions
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, interaction_id DESC) <= 500""")
def w1(spark, sf):
    return B.keep_latest(A.interactions(spark, sf), 500, keys=["agent_id"]).select("agent_id", "interaction_id")


def vote_records(spark, sf):
    d = A.interactions(spark, sf)
    k = F.col("interaction_id") % 3
    source = F.when(k == 0, "gold").when(k == 1, "silver").otherwise("bronze")
    d = (d.withColumn("source", source)
         .withColumn("weight", F.when(k == 0, 1.0).when(k == 1, 0.3).otherwise(0.5))
         .withColumn("voted", (k == 0) & F.col("actual_tier").isNotNull()))
    return d.select(
        F.col("interaction_id").alias("request_id"), "agent_id", F.col("ts").alias("asked_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("expires_at"), "predicted_tier", "actual_tier",
        "source", "weight", "voted",
        F.when(F.col("voted"), F.col("actual_tier") == F.col("predicted_tier")).alias("agreed"),
        F.when(F.col("voted") & (F.col("actual_tier") != F.col("predicted_tier")), F.col("actual_tier")).alias("correct_tier"))


RECORDS = f"""{Q.INTERACTIONS},
v0 AS (SELECT *, (['gold','silver','bronze'])[CAST(interaction_id % 3 AS INT)+1] AS source,
  ([1.0::DOUBLE,0.3::DOUBLE,0.5::DOUBLE])[CAST(interaction_id % 3 AS INT)+1] AS weight,
  interaction_id % 3 = 0 AND actual_tier IS NOT NULL AS voted FROM interactions),
votes AS (SELECT interaction_id AS request_id, agent_id, ts AS asked_at, ts + INTERVAL 5 MINUTE AS expires_at,
  predicted_tier, actual_tier, source, weight, voted,
  CASE WHEN voted THEN actual_tier = predicted_tier END AS agreed,
  CASE WHEN voted AND actual_tier <> predicted_tier THEN actual_tier END AS correct_tier FROM v0)"""


@query("t14_vote_filters", f"""WITH {RECORDS}, a AS (SELECT 'gold light of agent-3' AS pick, request_id FROM votes
    WHERE agent_id='agent-3' AND source='gold' AND predicted_tier='light'
  UNION ALL SELECT 'labelled', request_id FROM votes WHERE actual_tier IS NOT NULL AND asked_at < TIMESTAMP '{NOW}' AND weight >= 0.5)
  SELECT * FROM a""")
def t14(spark, sf):
    v = vote_records(spark, sf)
    a = B.votes(v, "agent-3", "gold", "light").select(F.lit("gold light of agent-3").alias("pick"), "request_id")
    return a.unionByName(B.labelled_votes(v, NOW, 0.5).select(F.lit("labelled").alias("pick"), "request_id"))


@query("w6_drop_expired", f"""WITH {RECORDS}, {Q.INDEX}
  SELECT 'votes' AS store, request_id AS id FROM votes WHERE expires_at > TIMESTAMP '{NOW}' OR actual_tier IS NOT NULL
  UNION ALL SELECT 'index', entry_id FROM idx WHERE 9000 - created < 5000""")
def w6(spark, sf):
    v = B.drop_expired_votes(vote_records(spark, sf), NOW).select(F.lit("votes").alias("store"), F.col("request_id").alias("id"))
    i = B.drop_expired_entries(A.index_entries(spark, sf), 9000, 5000)
    return v.unionByName(i.select(F.lit("index").alias("store"), F.col("entry_id").alias("id")))


@query("z8_purge_feedback", f"""{W} SELECT interaction_id FROM interactions WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY""")
def z8(spark, sf):
    return B.purge(A.interactions(spark, sf), NOW, 20).select("interaction_id")


# --- reports ------------------------------------------------------------------------
def evaluate_sql(src, pred="predicted_tier", act="actual_tier", name="ev"):
    tiers = Q.values(f"{name}_t", "tier", [(t,) for t in V.TIERS])
    return f"""{name}_c AS (SELECT coalesce({act},'moderate') AS a, {pred} AS p FROM {src}), {tiers},
{name}_p AS (SELECT a, count(*) AS n, sum((a=p)::INT) AS c FROM {name}_c GROUP BY a),
{name} AS (SELECT t.tier, coalesce(n,0)::BIGINT AS total, coalesce(c,0)::BIGINT AS correct, round(c/n::DOUBLE,4) AS accuracy
  FROM {name}_t t LEFT JOIN {name}_p x ON x.a=t.tier
  UNION ALL SELECT 'overall', count(*), sum((a=p)::INT)::BIGINT, round(avg((a=p)::INT),4) FROM {name}_c
  UNION ALL SELECT 'macro', (SELECT count(*) FROM {name}_c), (SELECT sum((a=p)::INT)::BIGINT FROM {name}_c), round(avg(c/n::DOUBLE),4) FROM {name}_p)"""


@query("a1_classifier_report", f"{W}, {evaluate_sql('interactions')} SELECT * FROM ev")
def a1(spark, sf):
    return B.evaluate(A.interactions(spark, sf))


@query("a1_confusion", f"""{W} SELECT coalesce(actual_tier,'moderate') AS actual,
  {','.join(f"count(*) FILTER (predicted_tier='{t}') AS {t}" for t in V.TIERS)} FROM interactions GROUP BY 1""")
def a1_confusion(spark, sf):
    return B.confusion_matrix(A.interactions(spark, sf))


@query("a2_tier_accuracy", f"""{W} SELECT predicted_tier AS tier, count(*) AS total, sum((predicted_tier=actual_tier)::INT)::BIGINT AS correct,
  round(avg((predicted_tier=actual_tier)::INT),6) AS accuracy FROM interactions WHERE actual_tier IS NOT NULL GROUP BY 1""")
def a2(spark, sf):
    return B.tier_accuracy(A.interactions(spark, sf)).withColumn("accuracy", rnd("accuracy"))


PRICES = Q.values("prices", "m,pi,po", V.PRICING)
COSTS = f"""{PRICES}, co_p AS (SELECT i.*, coalesce(a.pi,b.pi,c.pi,0) AS pi, coalesce(a.po,b.po,c.po,0) AS po,
    coalesce(a.m,b.m,c.m) IS NOT NULL AS priced FROM interactions i LEFT JOIN prices a ON a.m=routed_model
    LEFT JOIN prices b ON starts_with(routed_model,'openrouter/') AND b.m=substr(routed_model,12)
    LEFT JOIN prices c ON NOT starts_with(routed_model,'openrouter/') AND c.m='openrouter/'||routed_model),
costs AS (SELECT *, tokens_in/1e6::DOUBLE*pi + tokens_out/1e6::DOUBLE*po AS cost_usd,
    tokens_in/1e6::DOUBLE*5 + tokens_out/1e6::DOUBLE*25 AS baseline_cost_usd FROM co_p)"""


def costs(spark, sf):
    return R.request_cost(A.interactions(spark, sf), R.pricing(spark))


def _fit(spark, sf):
    """Interactions with a rating, over- and underkill and both costs."""
    gap = F.col("predicted_idx") - F.col("actual_idx")
    d = costs(spark, sf).where("actual_idx IS NOT NULL")
    return (d.withColumn("was_overkill", gap > 0).withColumn("was_underkill", gap < 0)
            .withColumn("self_rating", 1.0 - F.abs(gap) * 0.25)
            .withColumn("cost_actual", F.col("cost_usd")).withColumn("cost_predicted", F.col("baseline_cost_usd")))


@query("a3_routing_metrics", f"""{W}, {COSTS}, f AS (SELECT *, predicted_idx-actual_idx AS gap FROM costs WHERE actual_idx IS NOT NULL AND ts >= TIMESTAMP '{SINCE}'),
  g AS (SELECT predicted_tier AS tier, * FROM f UNION ALL SELECT 'overall', * FROM f)
  SELECT tier, count(*) AS total, round(avg((predicted_tier=actual_tier)::INT),3) AS accuracy, round(avg((gap>0)::INT),3) AS overkill_rate,
    round(avg((gap<0)::INT),3) AS underkill_rate, round(avg(1.0-abs(gap)*0.25),3) AS avg_self_rating, round(sum(cost_usd),4) AS total_cost,
    round(sum(baseline_cost_usd),4) AS predicted_cost, round((1-sum(cost_usd)/sum(baseline_cost_usd))*100,1) AS cost_savings_pct FROM g GROUP BY tier""")
def a3(spark, sf):
    return B.routing_metrics(_fit(spark, sf), SINCE)


@query("a6_daily_summary", f"""{W}, {COSTS}, d AS (SELECT strftime(ts,'%Y-%m-%d') AS date, * FROM costs),
  t AS (SELECT date, count(*) AS total_requests, sum(tokens_in)::BIGINT AS total_tokens_in, sum(tokens_out)::BIGINT AS total_tokens_out,
    sum(cost_usd) AS c, sum(baseline_cost_usd) AS b FROM d GROUP BY date),
  k AS (SELECT date, 'tier' AS kind, predicted_tier AS name, count(*) AS n FROM d GROUP BY 1,3 UNION ALL SELECT date, 'model', routed_model, count(*) FROM d GROUP BY 1,3)
  SELECT t.date, total_requests, total_tokens_in, total_tokens_out, round(c,8) AS total_cost_usd, round(b,8) AS baseline_cost_usd,
    round(b-c,8) AS total_savings_usd, round((b-c)/b*100,6) AS savings_pct, kind, name, n FROM t JOIN k USING (date)""")
def a6(spark, sf):
    d = B.daily_summary(costs(spark, sf))
    money = ["total_cost_usd", "baseline_cost_usd", "total_savings_usd", "savings_pct"]
    entries = F.concat(
        F.transform(F.map_entries("tier_distribution"), lambda e: F.struct(F.lit("tier").alias("kind"), e["key"].alias("name"), e["value"].alias("n"))),
        F.transform(F.map_entries("model_distribution"), lambda e: F.struct(F.lit("model").alias("kind"), e["key"].alias("name"), e["value"].alias("n"))))
    return d.select("date", "total_requests", "total_tokens_in", "total_tokens_out",
                    *[rnd(c, 6 if c == 'savings_pct' else 8).alias(c) for c in money], F.explode(entries).alias("e")).select(
        "date", "total_requests", "total_tokens_in", "total_tokens_out", *money, "e.kind", "e.name", "e.n")


@query("a7_cost_projection", f"""{W}, {COSTS}, d AS (SELECT strftime(ts,'%Y-%m-%d') AS date, * FROM costs),
  t AS (SELECT date, count(*) AS n, sum(cost_usd) AS c, sum(baseline_cost_usd) AS b FROM d GROUP BY date)
  SELECT t.date, round(c*30,8) AS monthly_cost, round((b-c)*30,8) AS monthly_savings, round((b-c)*365,8) AS annual_savings,
    d.predicted_tier AS tier, round(count(*)/max(n)::DOUBLE*100,4) AS share FROM t JOIN d USING (date) GROUP BY t.date, c, b, d.predicted_tier""")
def a7(spark, sf):
    d = B.cost_projection(B.daily_summary(costs(spark, sf)))
    return d.select("date", *[rnd(c, 8).alias(c) for c in ["monthly_cost", "monthly_savings", "annual_savings"]],
                    F.explode("tier_shares").alias("tier", "s")).withColumn("share", rnd("s", 4)).drop("s")


@query("a8_agent_usage", f"""{W} SELECT agent_id, count(*) AS requests, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
  max(ts) AS last_used FROM interactions GROUP BY 1""")
def a8(spark, sf):
    return B.agent_usage(A.interactions(spark, sf))


@query("a9_index_stats", f"""WITH {Q.INDEX} SELECT count(*) AS total, sum((9000-created < 5000)::INT)::BIGINT AS active,
  CAST(floor(coalesce(avg(compressed_tokens) FILTER (9000-created < 5000),0)+0.5) AS BIGINT) AS avg_tokens FROM idx""")
def a9(spark, sf):
    return B.index_stats(A.index_entries(spark, sf), 9000, 5000)


@query("a10_training_stats", f"""WITH {RECORDS}, l AS (SELECT *, actual_tier IS NOT NULL AND asked_at < TIMESTAMP '{NOW}' AS lab,
    coalesce(agreed OR correct_tier = predicted_tier, false) AS ok FROM votes)
  SELECT agent_id, sum((lab AND source='gold')::INT)::BIGINT AS total_votes, sum((lab AND source='gold' AND ok)::INT)::BIGINT AS correct_votes,
    count(*) AS total_requests, sum((NOT voted AND expires_at > TIMESTAMP '{NOW}' AND asked_at <= TIMESTAMP '{NOW}')::INT)::BIGINT AS pending_votes,
    sum((lab AND source='silver')::INT)::BIGINT AS silver_labels, sum((lab AND source='bronze')::INT)::BIGINT AS bronze_labels,
    round(exp(-count(*)/50.0::DOUBLE),9) AS fatigue, round(CASE WHEN sum(voted::INT)>0 THEN sum((voted AND ok)::INT)/sum(voted::INT)::DOUBLE ELSE -1 END,6) AS overall_accuracy
  FROM l GROUP BY agent_id""")
def a10(spark, sf):
    d = B.training_stats(vote_records(spark, sf), NOW)
    return d.withColumn("fatigue", rnd("fatigue", 9)).withColumn("overall_accuracy", rnd("overall_accuracy"))


@query("a10_agent_tier_accuracy", f"""WITH {RECORDS}, {Q.values('tt', 'tier', [(t,) for t in V.TIERS])},
  g AS (SELECT agent_id, predicted_tier AS tier, sum(voted::INT) AS total, sum((voted AND coalesce(agreed OR correct_tier=predicted_tier,false))::INT) AS correct FROM votes GROUP BY 1,2)
  SELECT a.agent_id, t.tier, coalesce(total,0)::BIGINT AS total, coalesce(correct,0)::BIGINT AS correct,
    round(CASE WHEN total>0 THEN correct/total::DOUBLE ELSE -1 END,6) AS accuracy
  FROM (SELECT DISTINCT agent_id FROM votes) a CROSS JOIN tt t LEFT JOIN g ON g.agent_id=a.agent_id AND g.tier=t.tier""")
def a10_tiers(spark, sf):
    return B.agent_tier_accuracy(vote_records(spark, sf)).withColumn("accuracy", rnd("accuracy"))


@query("a11_retrain_gate", f"""WITH {RECORDS}, l AS (SELECT * FROM votes WHERE actual_tier IS NOT NULL AND asked_at < TIMESTAMP '{NOW}' AND weight>=0.5),
  t AS (SELECT agent_id, predicted_tier, count(*) AS n, sum((source='gold')::INT) AS g FROM l GROUP BY 1,2)
  SELECT agent_id, sum(n)::BIGINT AS labelled, sum(g)::BIGINT AS gold_votes, sum((g>=3)::INT)::BIGINT AS tiers_with_min,
    (sum(g)>=10 AND sum((g>=3)::INT)>=2) OR sum(n)>=100 AS retrain FROM t GROUP BY 1""")
def a11(spark, sf):
    return B.retrain_gate(vote_records(spark, sf), NOW)


@query("a11_search_gate", f"""{W}, t AS (SELECT predicted_tier, count(*) AS n, count(actual_tier) AS j FROM interactions GROUP BY 1)
  SELECT sum(n)::BIGINT AS interactions, sum(j)::BIGINT AS judged, min(j) FILTER (j>0) AS least_per_tier, sum(j)>=300 AND min(j) FILTER (j>0)>=50 AS search_due,
  sum(n)>0 AND sum(n)%500=0 AS interval_due FROM t""")
def a11_search(spark, sf):
    return B.optimiser_gate(A.interactions(spark, sf))


def label_sources(spark, sf):
    """Gold from document labels, bronze and silver from the log."""
    gold = A.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.lit("gold").alias("source"),
        S.tier_at(F.col("quality") * 3 + F.col("toxic")).alias("tier"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("seq"))
    i = A.interactions(spark, sf).where("actual_tier IS NOT NULL")
    bronze = i.select(F.col("interaction_id").alias("id"), F.lit("bronze").alias("source"), F.col("actual_tier").alias("tier"),
                      F.lit(0.5).alias("weight"), F.lit(2).cast("long").alias("seq"))
    silver = A.interactions(spark, sf).select(
        F.col("interaction_id").alias("id"), F.lit("silver").alias("source"), F.col("predicted_tier").alias("tier"),
        F.when(F.col("interaction_id") % 2 == 0, 1.0).otherwise(0.4).alias("weight"), F.lit(1).cast("long").alias("seq"))
    return gold.unionByName(bronze).unionByName(silver)


@query("a14_combine_labels", f"""{W}, src AS (SELECT doc_id AS id, 'gold' AS source, {Q.tier_at('quality*3+toxic')} AS tier, 1.0::DOUBLE AS weight, 0 AS seq FROM labels
    UNION ALL SELECT interaction_id, 'bronze', actual_tier, 0.5, 2 FROM interactions WHERE actual_tier IS NOT NULL
    UNION ALL SELECT interaction_id, 'silver', predicted_tier, CASE WHEN interaction_id%2=0 THEN 1.0 ELSE 0.4 END, 1 FROM interactions),
  g AS (SELECT id, arg_min(tier, seq) AS tier FROM src WHERE source='gold' GROUP BY id),
  v AS (SELECT id, tier, sum(weight*CASE source WHEN 'silver' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END) AS w, min(seq) AS seq FROM src WHERE source<>'gold' GROUP BY 1,2),
  r AS (SELECT *, sum(w) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY round(w,9) DESC, seq) AS rn FROM v)
  SELECT id, tier, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS total_weight FROM g
  UNION ALL SELECT id, tier, round(least(1.0::DOUBLE, w/total),6), round(total,6) FROM r WHERE rn=1 AND id NOT IN (SELECT id FROM g)""")
def a14(spark, sf):
    d = B.combine_labels(label_sources(spark, sf))
    return d.withColumn("confidence", rnd("confidence")).withColumn("total_weight", rnd("total_weight"))


@query("a17_log_kpis", f"""{W}, k AS (SELECT *, {Q.midpoint('predicted_tier')} + (interaction_id%10)/100.0::DOUBLE AS score, predicted_idx < 2 AS loc FROM interactions)
  SELECT count(*) AS queries, CAST(floor(avg(latency_ms)+0.5) AS BIGINT) AS mean_latency_ms, CAST(floor(avg(loc::INT)*100+0.5) AS BIGINT) AS local_pct,
    round(count(*)*200/1e6::DOUBLE*2.5*floor(avg(loc::INT)*100+0.5)/100,6) AS estimated_savings,
    CAST(floor(avg((predicted_tier=actual_tier)::INT) FILTER (actual_tier IS NOT NULL)*100+0.5) AS BIGINT) AS accuracy_pct,
    round(avg(score) FILTER (predicted_tier='trivial'),6) AS mean_trivial, round(avg(score) FILTER (predicted_tier='extreme'),6) AS mean_extreme,
    round(avg(score) FILTER (predicted_tier='extreme')-avg(score) FILTER (predicted_tier='trivial'),6) AS delta,
    {','.join(f"count(*) FILTER (predicted_tier='{t}') AS n_{t}" for t in V.TIERS)} FROM k""")
def a17(spark, sf):
    d = A.interactions(spark, sf).withColumn("score", S.tier_value(F.col("predicted_tier")) + F.col("interaction_id") % 10 / 100.0)
    d = B.log_kpis(d, F.col("predicted_idx") < 2)
    for c in ["estimated_savings", "mean_trivial", "mean_extreme", "delta"]:
        d = d.withColumn(c, rnd(c))
    return d


@query("a18_label_agreement", f"""WITH {Q.PROMPTS}, {P.LABEL_SQL}, {Q.f1()}, {Q.cascade()}, j AS (SELECT l1.label AS a, casc.tier AS b FROM l1 JOIN casc USING (id))
  SELECT a AS label_a, b AS label_b, count(*) AS n, round((SELECT avg((a=b)::INT) FROM j),6) AS agreement FROM j GROUP BY 1,2""")
def a18(spark, sf):
    from tierflow.functions import features as X
    d = S.label_signals(A.prompts(spark, sf))
    d = S.cascade_score(X.prompt_features(d))
    return B.label_agreement(d, "label", "tier").withColumn("agreement", rnd("agreement"))


@query("a19_mix_projection", f"""{W}, {Q.values('uc', 'tier,unit', V.UNIT_COSTS)}, s AS (SELECT predicted_tier AS tier, count(*)/(SELECT count(*) FROM interactions)::DOUBLE AS share FROM interactions GROUP BY 1),
  d AS (SELECT tier, share*100000 AS m, share*100000*unit AS c FROM s JOIN uc USING (tier))
  SELECT tier, round(m,6) AS messages, round(c,6) AS daily_cost, round(c*30,6) AS monthly_cost, NULL::DOUBLE AS savings_pct FROM d
  UNION ALL SELECT 'total', round(sum(m),6), round(sum(c),6), round(sum(c*30),6), round((1-sum(c)/(sum(m)*0.075))*100,6) FROM d""")
def a19(spark, sf):
    c = A.interactions(spark, sf).groupBy(F.col("predicted_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    share = c.select("tier", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # six rows
    d = B.mix_projection(share, 100000)
    for x in ["messages", "daily_cost", "monthly_cost", "savings_pct"]:
        d = d.withColumn(x, rnd(x))
    return d


@query("a20_monitor_alerts", f"""{W}, {COSTS}, {Q.values('bd', 'tier,bound', V.ACCURACY_ALERTS)}, e AS (SELECT *, interaction_id%9=0 AS esc FROM costs)
  SELECT predicted_tier||' accuracy' AS metric, round(avg((predicted_tier=actual_tier)::INT) FILTER (actual_tier IS NOT NULL),6) AS value, max(bound) AS bound,
    avg((predicted_tier=actual_tier)::INT) FILTER (actual_tier IS NOT NULL) < max(bound) AS alert FROM e JOIN bd ON bd.tier=predicted_tier GROUP BY predicted_tier
  UNION ALL SELECT 'cost per message', round(avg(cost_usd),6), 0.02::DOUBLE, avg(cost_usd) > 0.02 FROM e
  UNION ALL SELECT 'escalation rate', round(avg(esc::INT),6), 0.2::DOUBLE, avg(esc::INT) > 0.2 FROM e""")
def a20(spark, sf):
    d = costs(spark, sf).withColumn("escalated", F.col("interaction_id") % 9 == 0)
    return B.monitor_alerts(d).withColumn("value", rnd("value"))


@query("a20_over_ceiling", f"""{W}, {COSTS}, {Q.values('ce', 'tier,ceiling', V.MAX_COST_PER_MESSAGE)}
  SELECT predicted_tier, count(*) AS n, round(sum(cost_usd),8) AS cost FROM costs JOIN ce ON ce.tier=predicted_tier WHERE cost_usd > ceiling GROUP BY 1""")
def a20_ceiling(spark, sf):
    return B.over_ceiling(costs(spark, sf)).groupBy("predicted_tier").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("cost_usd"), 8).alias("cost"))


@query("a21_store_composition", f"{W} SELECT predicted_tier AS tier, count(*) AS entries, count(actual_tier) AS judged FROM interactions GROUP BY 1")
def a21(spark, sf):
    return B.store_composition(A.interactions(spark, sf))


# --- joins --------------------------------------------------------------------------
@query("j1_join_pricing", f"{W}, {COSTS} SELECT routed_model, pi::DOUBLE AS price_in, po::DOUBLE AS price_out, priced, count(*) AS n FROM costs GROUP BY ALL")
def j1(spark, sf):
    return R.join_pricing(A.interactions(spark, sf), R.pricing(spark)).groupBy(
        "routed_model", "price_in", "price_out", "priced").agg(F.count(F.lit(1)).alias("n"))


@query("x18_request_cost", f"""{W}, {COSTS} SELECT interaction_id, round(cost_usd,9) AS cost_usd, round(baseline_cost_usd,9) AS baseline_cost_usd,
  round(baseline_cost_usd-cost_usd,9) AS savings_usd, round(CASE WHEN baseline_cost_usd>0 THEN (baseline_cost_usd-cost_usd)/baseline_cost_usd*100 ELSE 0 END,4) AS savings_pct, priced FROM costs""")
def x18(spark, sf):
    d = costs(spark, sf)
    return d.select("interaction_id", *[rnd(c, 9).alias(c) for c in ["cost_usd", "baseline_cost_usd", "savings_usd"]],
                    rnd("savings_pct", 4).alias("savings_pct"), "priced")


def _agents(spark, sf):
    """Registry out of the users seen in the log."""
    u = A.table(spark, sf, "events").select("user_id").distinct().where("user_id % 4 <> 3")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("user_id") % len(xs) + 1).cast("int"))
    return u.select(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("agent_key"),
                    F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"),
                    pick(["bailian", "zai", "openrouter"]).alias("provider"),
                    pick(["cost-optimized", "quality", "benchmark", "unknown-profile", "balanced"]).alias("profile"))


def _keyed(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "user_id")
    return e.select("event_id", F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("agent_key"),
                    S.tier_at((F.col("event_id") * 7 + F.col("user_id")) % 6).alias("tier"))


AGENTS = f"""reg AS (SELECT DISTINCT 'key-'||user_id AS agent_key, 'agent-'||user_id AS agent_id,
   (['bailian','zai','openrouter'])[CAST(user_id%3 AS INT)+1] AS provider,
   (['cost-optimized','quality','benchmark','unknown-profile','balanced'])[CAST(user_id%5 AS INT)+1] AS profile FROM events WHERE user_id % 4 <> 3),
keyed AS (SELECT event_id, 'key-'||user_id AS agent_key, {Q.tier_at('(event_id*7+user_id) % 6')} AS tier FROM events),
aj AS (SELECT k.*, coalesce(r.agent_id,'default') AS agent_id, coalesce(r.provider,'moa') AS agent_provider, coalesce(r.profile,'balanced') AS profile
  FROM keyed k LEFT JOIN reg r USING (agent_key))"""


@query("j2_join_agents", f"WITH {AGENTS} SELECT agent_id, agent_provider, profile, count(*) AS n FROM aj GROUP BY ALL")
def j2(spark, sf):
    return R.join_agents(_keyed(spark, sf), _agents(spark, sf)).groupBy("agent_id", "agent_provider", "profile") \
        .agg(F.count(F.lit(1)).alias("n"))


_PROF = Q.values("prof", "p,t,m", [(p, t, m) for p, ms in V.AGENT_PROFILES.items() for t, m in zip(V.TIERS, ms)])


@query("j8_route_by_agent", f"""WITH {AGENTS}, {_PROF}, m AS (SELECT aj.*, prof.m FROM aj JOIN prof ON prof.t=aj.tier AND prof.p=CASE WHEN profile IN
   ('cost-optimized','quality','balanced','benchmark') THEN profile ELSE 'balanced' END)
  SELECT profile, tier, CASE WHEN starts_with(m,'openrouter/') THEN 'openrouter' WHEN starts_with(m,'glm-') THEN 'zai' ELSE 'bailian' END AS provider,
    regexp_replace(m,'^openrouter/','') AS model, count(*) AS n FROM m GROUP BY ALL""")
def j8(spark, sf):
    d = R.route_by_agent(R.join_agents(_keyed(spark, sf), _agents(spark, sf)), spark)
    return d.groupBy("profile", "tier", "provider", "model").agg(F.count(F.lit(1)).alias("n"))


def judgements(spark, sf):
    """Late judgements, some twice: the newest counts."""
    d = A.interactions(spark, sf)
    times = F.explode(F.when(F.col("interaction_id") % 4 == 0, F.array(F.lit(1), F.lit(2)))
                      .when(F.col("interaction_id") % 4 == 1, F.array(F.lit(1))))
    return d.select("interaction_id", "predicted_idx", times.alias("judged_at")).select(
        "interaction_id", "judged_at", (F.col("judged_at") * 0.3 + 0.1).alias("adequacy"),
        S.tier_at((F.col("predicted_idx") + F.col("judged_at")) % 6).alias("actual_tier"))


@query("j3_merge_judgements", f"""{W}, j AS (SELECT interaction_id, predicted_idx, unnest(CASE WHEN interaction_id%4=0 THEN [1,2] WHEN interaction_id%4=1 THEN [1] ELSE [] END) AS jat FROM interactions),
  l AS (SELECT interaction_id, max(jat) AS jat, max(predicted_idx) AS p FROM j GROUP BY 1)
  SELECT i.interaction_id, CASE WHEN l.jat IS NULL THEN adequacy ELSE l.jat*0.3::DOUBLE+0.1::DOUBLE END AS adequacy,
    CASE WHEN l.jat IS NULL THEN actual_tier ELSE {Q.tier_at('(p+l.jat)%6')} END AS actual_tier FROM interactions i LEFT JOIN l USING (interaction_id)""")
def j3(spark, sf):
    return B.merge_judgements(A.interactions(spark, sf), judgements(spark, sf)).select("interaction_id", "adequacy", "actual_tier")


MATCH = f"""{Q.VOTES}, pr AS (SELECT *, lower(regexp_extract(reply_text,{Q.s(P._VRE)},1)) AS m, nullif(lower(regexp_extract(reply_text,{Q.s(P._VRE)},2)),'') AS ct FROM replies),
ev AS (SELECT agent_id, asked_at AS t, 0 AS kind, request_id AS id, predicted_tier, NULL AS agreed, NULL AS correct_tier FROM requests
  UNION ALL SELECT agent_id, replied_at, 1, reply_id, NULL, m IN ('✅','yes','correct','👍') AND ct IS NULL, ct FROM pr WHERE m <> ''),
e1 AS (SELECT *, sum(CASE kind WHEN 0 THEN 1 ELSE -1 END) OVER (PARTITION BY agent_id ORDER BY t,kind,id) AS s FROM ev),
e2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY agent_id ORDER BY t,kind,id)) AS depth FROM e1),
e3 AS (SELECT *, CASE kind WHEN 0 THEN depth ELSE coalesce(lag(depth) OVER (PARTITION BY agent_id ORDER BY t,kind,id),0) END AS level FROM e2),
e4 AS (SELECT *, lag(id) OVER w AS rid, lag(t) OVER w AS rt, lag(predicted_tier) OVER w AS rp FROM e3 WHERE level>0 WINDOW w AS (PARTITION BY agent_id, level ORDER BY t,kind,id)),
matched AS (SELECT id AS reply_id, agent_id, rid AS request_id, rp AS predicted_tier, agreed, correct_tier FROM e4 WHERE kind=1 AND t < rt + INTERVAL 300 SECOND)"""


@query("j4_match_votes", f"WITH {MATCH} SELECT * FROM matched")
def j4(spark, sf):
    return B.match_votes(A.vote_replies(spark, sf), A.vote_requests(spark, sf))


@query("j5_apply_votes", f"""WITH {MATCH} SELECT request_id, predicted_tier, CASE WHEN agreed THEN predicted_tier ELSE coalesce(correct_tier, predicted_tier) END AS actual_tier,
  agreed OR coalesce(correct_tier=predicted_tier,false) AS is_correct FROM matched""")
def j5(spark, sf):
    return B.apply_votes(B.match_votes(A.vote_replies(spark, sf), A.vote_requests(spark, sf))).select(
        "request_id", "predicted_tier", "actual_tier", "is_correct")


@query("j6_compare_tiers", f"""WITH {Q.PROMPTS}, {P.LABEL_SQL}, {Q.f1('l1')}, h AS (SELECT *, {Q.tier_of(Q.heuristic(), V.CLASSIC_BOUNDS)} AS base FROM f1),
  {Q.cascade('h')}, {evaluate_sql('casc', 'base', 'label', 'ea')}, {evaluate_sql('casc', 'tier', 'label', 'eb')}
  SELECT a.tier, a.accuracy AS baseline, b.accuracy AS cascade, round(b.accuracy-a.accuracy,4) AS delta, a.correct AS baseline_correct,
    b.correct AS cascade_correct, a.total FROM ea a JOIN eb b USING (tier) WHERE tier NOT IN ('overall','macro') AND a.accuracy IS NOT NULL""")
def j6(spark, sf):
    from tierflow.functions import features as X
    d = X.prompt_features(S.label_signals(A.prompts(spark, sf)))
    d = S.cascade_score(d.withColumn("base", S.tier_classic(S.heuristic_score())))
    # both reports start from the same small counts, whose shuffle Spark reuses
    n = d.groupBy("label", "base", "tier").agg(F.count(F.lit(1)).alias("n"))
    return B.compare_tiers(B.evaluate(n, "base", "label", "n"), B.evaluate(n, "tier", "label", "n"))


@query("j7_resolve_fallbacks", f"""WITH {Q.ATTEMPTS}, {P.CHAIN_SQL}, j AS (SELECT a.*, c.model, c.provider,
    NOT (status IN ('429','1305','1308','timeout') OR regexp_matches(status,'^5[0-9][0-9]$')) AS done FROM attempts a JOIN chain c ON c.tier=a.predicted_tier AND c.pos=a.pos),
  f AS (SELECT interaction_id, predicted_tier, min(pos) FILTER (done) AS pos, count(*) AS n FROM j GROUP BY 1,2)
  SELECT f.interaction_id, f.predicted_tier, f.pos::BIGINT AS pos, j.model, j.provider, CASE WHEN f.pos IS NULL THEN 'unavailable' WHEN j.status='200' THEN 'success' ELSE 'error' END AS outcome,
    coalesce(f.pos+1, f.n)::BIGINT AS tried FROM f LEFT JOIN j ON j.interaction_id=f.interaction_id AND j.pos=f.pos""")
def j7(spark, sf):
    return R.resolve_fallbacks(A.attempts(spark, sf), R.tier_routes(spark))


@query("x17_apply_judgements", f"""WITH {Q.RESPONSES}, {P.quick_sql()}, j AS (SELECT id, CASE WHEN id%3=0 THEN -1 ELSE (id%13)/10.0 END::DOUBLE AS a,
    CASE WHEN id%5=0 THEN 'bogus' ELSE {Q.tier_at('id%6')} END AS t FROM quick WHERE id%4<>0)
  SELECT q.id, CASE WHEN a>=0 THEN {Q.clamp('a')} END AS judge_score, CASE WHEN a>=0 AND t <> 'bogus' THEN t END AS judged_tier,
    coalesce(CASE WHEN a>=0 THEN {Q.clamp('a')} END < 0.6, quick < 0.5) AS should_escalate FROM quick q LEFT JOIN j USING (id)""")
def x17(spark, sf):
    d = P.quick(spark, sf)
    i = F.col("id")
    j = A.responses(spark, sf).where(i % 4 != 0).select(
        "id", F.when(i % 3 == 0, -1.0).otherwise(i % 13 / 10.0).alias("adequacy"),
        F.when(i % 5 == 0, "bogus").otherwise(S.tier_at(i % 6)).alias("correct_tier"))
    return B.apply_judgements(d, j).select("id", "judge_score", "judged_tier", "should_escalate")


# --- windows --------------------------------------------------------------------------
@query("w2_calibration", f"""{W}, r AS (SELECT interaction_id, ts, actual_tier = predicted_tier AS b, CASE WHEN interaction_id%2=0 THEN interaction_id%10<>0 END AS s FROM interactions),
  c AS (SELECT *, count(b) OVER w AS bn, coalesce(sum(b::INT) OVER w,0) AS ba, count(s) OVER w AS sn, coalesce(sum(s::INT) OVER w,0) AS sa, count(*) OVER w AS n FROM r WINDOW w AS (ORDER BY ts, interaction_id)),
  v AS (SELECT *, CASE WHEN s IS NOT NULL AND sn>=10 AND sa/sn::DOUBLE>0.7 THEN {Q.clamp('sa/sn::DOUBLE*0.3::DOUBLE', '0.1', '0.9')} END AS nw FROM c),
  l AS (SELECT *, coalesce(last_value(nw IGNORE NULLS) OVER (ORDER BY ts, interaction_id ROWS UNBOUNDED PRECEDING),0.3::DOUBLE) AS full_w FROM v)
  SELECT interaction_id, round(CASE WHEN bn>=10 THEN {Q.clamp('ba/bn::DOUBLE*0.5::DOUBLE', '0.1', '0.8')} ELSE 0.5 END,6) AS bronze_weight,
    CASE WHEN n<50 THEN 'disabled' WHEN n<200 THEN 'low' ELSE 'full' END AS phase, round(CASE WHEN n<50 THEN 0 WHEN n<200 THEN full_w*0.5 ELSE full_w END,6) AS silver_weight FROM l""")
def w2(spark, sf):
    i = F.col("interaction_id")
    d = B.calibration(A.interactions(spark, sf), F.col("actual_tier") == F.col("predicted_tier"), F.when(i % 2 == 0, i % 10 != 0))
    return d.select("interaction_id", rnd("bronze_weight").alias("bronze_weight"), "phase", rnd("silver_weight").alias("silver_weight"))


def _bias_sql(n, up, down, low):
    return f"CASE WHEN {n}<5 OR {up}+{down}<3 THEN 0 ELSE {Q.clamp(f'{up}*0.02::DOUBLE-{down}*0.02::DOUBLE+CASE WHEN {low}/{n}::DOUBLE>0.3 THEN 0.05::DOUBLE ELSE 0 END', '-0.1', '0.1')} END"


BIAS_FLAGS = ("bf AS (SELECT *, coalesce(actual_idx>predicted_idx,false)::INT AS up, coalesce(actual_idx<predicted_idx,false)::INT AS down, "
              "(coalesce(adequacy,0.5)<0.6)::INT AS low FROM interactions)")


@query("w3_history_bias", f"""{W}, {BIAS_FLAGS}, r AS (SELECT interaction_id, count(*) OVER w AS n, coalesce(sum(up) OVER w,0) AS u, coalesce(sum(down) OVER w,0) AS d, coalesce(sum(low) OVER w,0) AS l
    FROM bf WINDOW w AS (PARTITION BY agent_id ORDER BY ts, interaction_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
  SELECT interaction_id, round({_bias_sql('n', 'u', 'd', 'l')},6) AS bias FROM r""")
def w3(spark, sf):
    return B.history_bias(A.interactions(spark, sf), chunk=300).select("interaction_id", rnd("bias").alias("bias"))


@query("w3_history_bias_now", f"""{W}, {BIAS_FLAGS}, t AS (SELECT * FROM bf ORDER BY ts DESC, interaction_id DESC LIMIT 50),
  s AS (SELECT count(*) AS n, sum(up) AS u, sum(down) AS d, sum(low) AS l FROM t) SELECT round({_bias_sql('n', 'u', 'd', 'l')},6) AS bias FROM s""")
def w3_now(spark, sf):
    return B.history_bias_now(A.interactions(spark, sf)).select(rnd("bias").alias("bias"))


def talk(spark, sf):
    i = F.col("interaction_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("Decision: keep "), F.col("routed_model"), F.lit("\nNote that step "), i.cast("string"))).otherwise("no outcome")
    return A.interactions(spark, sf).withColumn("response_text", text)


TALK = f"""{Q.INTERACTIONS}, k0 AS (SELECT *, CASE WHEN interaction_id%3=0 THEN 'Decision: keep '||routed_model||chr(10)||'Note that step '||interaction_id ELSE 'no outcome' END AS response_text,
   lag(ts) OVER w AS pt, lag(routed_model) OVER w AS pm FROM interactions WINDOW w AS (PARTITION BY agent_id ORDER BY ts, interaction_id)),
k1 AS (SELECT *, (pt IS NULL OR ts > pt + INTERVAL 1 HOUR)::INT AS fresh FROM k0),
turns AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id ORDER BY ts, interaction_id) AS session_no, fresh=0 AND pm<>routed_model AS switched FROM k1)"""


@query("w5_session_continuity", f"""WITH {TALK} SELECT agent_id, session_no::BIGINT AS session_no, arg_max(predicted_tier, (ts, interaction_id)) AS last_tier,
  arg_max(routed_model, (ts, interaction_id)) AS last_model, count(*) AS turns, sum(switched::INT)::BIGINT AS switches FROM turns GROUP BY 1,2""")
def w5(spark, sf):
    return B.session_state(B.session_turns_log(talk(spark, sf)))[0]


@query("w5_key_decisions", f"""WITH {TALK}, d AS (SELECT agent_id, session_no, ts, interaction_id, unnest(l) AS decision, generate_subscripts(l,1)-1 AS n
    FROM (SELECT *, {P._decisions('response_text')} AS l FROM turns)),
  r AS (SELECT *, row_number() OVER (PARTITION BY agent_id, session_no ORDER BY ts DESC, interaction_id DESC, n DESC) AS rank FROM d)
  SELECT agent_id, session_no::BIGINT AS session_no, rank, decision FROM r WHERE rank <= 10""")
def w5_decisions(spark, sf):
    d = B.session_state(B.session_turns_log(talk(spark, sf)))[1]
    return d.select("agent_id", "session_no", F.col("rank").cast("long").alias("rank"), "decision")


def _rate_sql(n):
    return f"least(0.5::DOUBLE, greatest(0.02::DOUBLE, exp(-({n})/50.0::DOUBLE)*0.1)*CASE WHEN predicted_tier IN ('moderate','heavy','intensive') THEN 2 ELSE 1 END)"


# one step per row of an agent: the count of asks so far decides the next
ASKS = f"""c0 AS MATERIALIZED (SELECT *, predicted_tier IN ('trivial','extreme') AS never, (interaction_id%10)/10.0 < 0.5 AS unsure,
    {Q.uhash('interaction_id', 42)}/4294967296.0::DOUBLE AS u, row_number() OVER (PARTITION BY agent_id ORDER BY ts, interaction_id) AS rn FROM interactions),
walk AS (SELECT DISTINCT agent_id, 1::BIGINT AS rn, 0::BIGINT AS prior_asks FROM c0
  UNION ALL SELECT w.agent_id, w.rn+1, w.prior_asks + (NOT never AND (unsure OR u < {_rate_sql('w.prior_asks')}))::BIGINT
  FROM walk w JOIN c0 c ON c.agent_id=w.agent_id AND c.rn=w.rn),
pa AS (SELECT c.*, prior_asks, NOT never AND (unsure OR u < {_rate_sql('prior_asks')}) AS asked FROM c0 c JOIN walk w ON c.agent_id=w.agent_id AND c.rn=w.rn)"""
WR = f"WITH RECURSIVE {Q.INTERACTIONS}"


def ask_log(spark, sf):
    return A.interactions(spark, sf).select("interaction_id", "agent_id", "ts", "predicted_tier", (F.col("interaction_id") % 10 / 10.0).alias("confidence"))


@query("w7_ask_rate", f"{WR}, {ASKS} SELECT interaction_id, prior_asks, asked, round({_rate_sql('prior_asks')},9) AS rate FROM pa")
def w7(spark, sf):
    d = K.with_asks(ask_log(spark, sf))
    return d.select("interaction_id", "prior_asks", "asked", rnd(K.ask_rate(F.col("prior_asks"), F.col("predicted_tier")), 9).alias("rate"))


# --- sampling ----------------------------------------------------------------------------
@query("p4_sample_for_votes", f"{WR}, {ASKS} SELECT interaction_id FROM pa WHERE asked")
def p4(spark, sf):
    return K.sample_for_votes(ask_log(spark, sf)).select("interaction_id")


@query("p4_sample_unjudged", f"{W} SELECT interaction_id FROM interactions WHERE adequacy IS NULL AND {Q.uhash('interaction_id', 42)}/4294967296.0::DOUBLE < 0.1")
def p4_unjudged(spark, sf):
    return B.sample_unjudged(A.interactions(spark, sf)).select("interaction_id")


@query("p5_sample_per_tier", f"""{W} SELECT predicted_tier, interaction_id FROM interactions
  QUALIFY row_number() OVER (PARTITION BY predicted_tier ORDER BY {Q.uhash('interaction_id', 42)}, interaction_id) <= 200""")
def p5(spark, sf):
    return B.sample_per_tier(A.interactions(spark, sf), 200).select("predicted_tier", "interaction_id")


@query("p6_ab_report", f"""{W}, a AS (SELECT *, CASE WHEN {Q.uhash('interaction_id', 42)}/4294967296.0::DOUBLE < 0.1 THEN 'holdout' ELSE 'new' END AS arm FROM interactions)
  SELECT arm, count(*) AS n, count(actual_tier) AS judged, round(avg((predicted_tier=actual_tier)::INT) FILTER (actual_tier IS NOT NULL),6) AS accuracy FROM a GROUP BY 1""")
def p6(spark, sf):
    return B.ab_report(B.ab_split(A.interactions(spark, sf))).withColumn("accuracy", rnd("accuracy"))


# --- retrieval -----------------------------------------------------------------------------
def retrieve_sql(k, name="got", distinct=False, now=None, ttl=None, n=I.MAX_ENTRIES):
    live = f"SELECT * FROM (SELECT * FROM idx ORDER BY created DESC, entry_id DESC LIMIT {n or 1 << 60})" + (f" WHERE {now} - created < {ttl}" if now else "")
    return f"""{Q.INDEX}, live AS ({live}),
lt AS (SELECT entry_id, created, unnest(list_distinct(list_concat(keywords, tags))) AS term FROM live),
rq AS (SELECT conv_id*100+turn AS query_id, text, {Q.kw('text', distinct)} AS keywords FROM conversations WHERE role='user'),
qt AS (SELECT query_id, unnest(keywords) AS kw, generate_subscripts(keywords,1) AS i FROM rq),
sc AS (SELECT query_id, entry_id, created, count(DISTINCT i) AS score FROM qt JOIN lt ON contains(term,kw) OR contains(kw,term) GROUP BY 1,2,3),
{name} AS (SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created, entry_id) AS rank FROM sc QUALIFY rank <= {k})"""


@query("r1_retrieve", f"WITH {retrieve_sql(3)} SELECT * FROM got")
def r1(spark, sf):
    return I.retrieve(A.retrieval_queries(spark, sf), A.index_entries(spark, sf), 3)


@query("r1_retrieve_recent", f"WITH {retrieve_sql(10, distinct=True, now=9999, ttl=6000, n=200)} SELECT * FROM got")
def r1_recent(spark, sf):
    return I.retrieve(A.retrieval_queries(spark, sf, True), A.index_entries(spark, sf), 10, now=9999, ttl=6000, max_entries=200)


def signal_sql(variant):
    d = 0.3 if variant == "scorer" else 0.5
    v = Q.case_map("l.tier", V.RETRIEVAL_TIER_VALUES.items(), d)
    e = f"avg({v})" if variant == "scorer" else f"least(1.0::DOUBLE, avg({v}) + CASE WHEN max((adequacy<0.6)::INT)=1 THEN 0.1::DOUBLE ELSE 0 END)"
    return f"""{retrieve_sql(5)}, sg0 AS (SELECT query_id, {e} AS v FROM got g JOIN live l USING (entry_id) GROUP BY 1),
sg AS (SELECT rq.query_id, rq.text, coalesce(v, 0.5::DOUBLE) AS retrieval FROM rq LEFT JOIN sg0 USING (query_id))"""


for _v in ("scorer", "voter"):
    @query(f"x11_retrieval_signal_{_v}", f"WITH {signal_sql(_v)} SELECT query_id, round(retrieval,6) AS retrieval FROM sg")
    def x11(spark, sf, v=_v):
        return I.retrieval_signal(A.retrieval_queries(spark, sf), A.index_entries(spark, sf), v).select(
            "query_id", rnd("retrieval").alias("retrieval"))


def vote_sql(src, h="h", r="r", b="b", c="NULL::DOUBLE", w=V.ENSEMBLE_WEIGHTS, name="vt"):
    m = f"(({h}+{c}+{r})/3.0)"
    conf = (f"CASE WHEN {c} IS NULL THEN 0.7::DOUBLE ELSE greatest(0::DOUBLE, 1-sqrt((pow({h}-{m},2)+pow({c}-{m},2)+pow({r}-{m},2))/3.0)*3.0) END")
    return f"""{name}_s AS (SELECT *, {Q.clamp(f"CASE WHEN {c} IS NULL THEN {h}*{w['heuristic']!r}::DOUBLE+{r}*{w['retrieval']!r}::DOUBLE+{b} ELSE {h}*{w['heuristic']!r}::DOUBLE+{c}*{w['cascade']!r}::DOUBLE+{r}*{w['retrieval']!r}::DOUBLE+{b} END")} AS final_score,
   {conf} AS confidence FROM {src}),
{name}_t AS (SELECT *, {Q.tier_of('final_score', V.CALIBRATED_BOUNDS)} AS t0 FROM {name}_s),
{name} AS (SELECT * EXCLUDE (t0), CASE WHEN confidence<0.5 THEN 'intensive' WHEN confidence<0.8 THEN {Q.tier_at(f"least({Q.tier_idx('t0')}+1,5)")} ELSE t0 END AS tier,
   confidence<0.5 OR (confidence<0.8 AND t0<>'extreme') AS escalated FROM {name}_t)"""


@query("x12_ensemble_vote", f"""WITH {Q.INTERACTIONS}, e AS (SELECT interaction_id, (latency_ms%1000)/1000.0::DOUBLE AS h, (tokens_in%97)/97.0::DOUBLE AS r,
    (interaction_id%9-4)/50.0::DOUBLE AS b, CASE WHEN interaction_id%3=0 THEN NULL ELSE (tokens_out%89)/89.0::DOUBLE END AS c FROM interactions),
  {vote_sql('e', c='c', w={'heuristic': 0.4, 'cascade': 0.3, 'retrieval': 0.15, 'history': 0.15})}
  SELECT interaction_id, round(final_score,6) AS final_score, round(confidence,6) AS confidence, tier, escalated FROM vt""")
def x12(spark, sf):
    i = F.col("interaction_id")
    d = A.interactions(spark, sf).select(
        "interaction_id", (F.col("latency_ms") % 1000 / 1000.0).alias("heuristic"), (F.col("tokens_in") % 97 / 97.0).alias("retrieval"),
        ((i % 9 - 4) / 50.0).alias("bias"), F.when(i % 3 != 0, F.col("tokens_out") % 89 / 89.0).alias("cascade"))
    w = {"heuristic": 0.4, "cascade": 0.3, "retrieval": 0.15, "history": 0.15}
    return S.ensemble_vote(d, cascade="cascade", weights=w).select(
        "interaction_id", rnd("final_score").alias("final_score"), rnd("confidence").alias("confidence"), "tier", "escalated")


@query("x13_normalise_weights", f"""{W}, w AS (SELECT agent_id, count(*) FILTER (predicted_idx<2)::DOUBLE AS h, count(*) FILTER (predicted_idx=2)::DOUBLE AS c,
    count(*) FILTER (predicted_idx=3)::DOUBLE AS r, count(*) FILTER (predicted_idx>3)::DOUBLE AS b FROM interactions GROUP BY 1)
  SELECT agent_id, round(h/(h+c+r+b),6) AS heuristic, round(c/(h+c+r+b),6) AS cascade, round(r/(h+c+r+b),6) AS retrieval, round(b/(h+c+r+b),6) AS history FROM w""")
def x13(spark, sf):
    n = lambda c: F.sum(c.cast("double"))
    p = F.col("predicted_idx")
    d = A.interactions(spark, sf).groupBy("agent_id").agg(n(p < 2).alias("heuristic"), n(p == 2).alias("cascade"),
                                                          n(p == 3).alias("retrieval"), n(p > 3).alias("history"))
    return d.select("agent_id", *[rnd(c).alias(k) for k, c in S.normalised_columns(list(V.ENSEMBLE_WEIGHTS)).items()])


@query("x14_intent_score", f"""WITH {Q.INTERACTIONS}, {BIAS_FLAGS}, bt AS (SELECT * FROM bf ORDER BY ts DESC, interaction_id DESC LIMIT 50),
  bs AS (SELECT count(*) AS n, sum(up) AS u, sum(down) AS d, sum(low) AS l FROM bt), bb AS (SELECT {_bias_sql('n', 'u', 'd', 'l')} AS b FROM bs),
  {signal_sql('scorer')}, {Q.f5('sg')}, e AS (SELECT query_id, {Q.GATEWAY_HEURISTIC} AS h, retrieval AS r, (SELECT b FROM bb) AS b FROM f5), {vote_sql('e')}
  SELECT query_id, round(final_score,6) AS final_score, confidence, tier, escalated FROM vt""")
def x14(spark, sf):
    d = I.intent_score(A.retrieval_queries(spark, sf), A.index_entries(spark, sf), A.interactions(spark, sf))
    return d.select("query_id", rnd("final_score").alias("final_score"), "confidence", "tier", "escalated")


@query("a13_consensus_label", f"""WITH {retrieve_sql(10)}, n AS (SELECT query_id, tier, count(*) AS n, min(rank) AS f FROM got JOIN live USING (entry_id) GROUP BY 1,2),
  b AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS found, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS rn FROM n)
  SELECT query_id, tier AS label, n AS agree, found::BIGINT AS found FROM b WHERE rn=1 AND n>=3 AND n/found::DOUBLE>0.6""")
def a13(spark, sf):
    return I.consensus_label(A.retrieval_queries(spark, sf), A.index_entries(spark, sf))


# --- feedback to samples -----------------------------------------------------------------
_EVAL = f"WITH {Q.RESPONSES}, {P.assess_sql('responses')}, tx AS (SELECT *, prompt AS text FROM assessed), {Q.f3('tx')}"


@query("m8_evaluate_interactions", f"""{_EVAL} SELECT id, substr(sha256(prompt),1,16) AS prompt_hash, substr(prompt,1,200) AS prompt_summary, actual_tier, self_rating,
  was_overkill, was_underkill, word_count, sentence_count, avg_word_length, technical_terms, domain_specificity FROM f3""")
def m8(spark, sf):
    d = B.evaluate_interactions(P._responses(spark, sf))
    return d.select("id", "prompt_hash", "prompt_summary", "actual_tier", "self_rating", "was_overkill", "was_underkill",
                    "word_count", "sentence_count", "avg_word_length", "technical_terms", "domain_specificity")


@query("m7_feedback_samples", f"""{_EVAL} SELECT 'fb_'||substr(sha256(prompt),1,16)||'_'||id AS sample_id, 'feedback-loop' AS source, substr(prompt,1,200) AS text,
  actual_tier AS label, self_rating AS confidence FROM f3""")
def m7(spark, sf):
    return B.feedback_samples(B.evaluate_interactions(P._responses(spark, sf)))

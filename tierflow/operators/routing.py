"""Routes, providers, prices and fallback chains.

All right-hand tables here are fixed-size dimensions (tiers, models, prices), so they
are broadcast; their size does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions import features as X, scoring as S
from tierflow.operators.scale import dimension


def routes(spark, rows=V.DEFAULT_ROUTES) -> DataFrame:
    return dimension(spark, ["tier", "model", "provider", "max_tokens"], [r[:4] for r in rows])


def tier_routes(spark, cfg=V.GATEWAY_ROUTES) -> DataFrame:
    """Ordered chain per tier: position 0 is the primary model; copies of it are skipped."""
    rows = []
    for tier, model, provider, max_tokens, thinking, fallbacks in cfg:
        chain = [(model, provider)] + [f for f in fallbacks if f != (model, provider)]
        rows += [(tier, i, m, p, max_tokens, thinking) for i, (m, p) in enumerate(chain)]
    return dimension(spark, ["tier", "pos", "model", "provider", "max_tokens", "thinking"], rows)


def route(df: DataFrame, route_table: DataFrame, tier: str = "tier") -> DataFrame:
    """Model, provider and token limit of the tier; an unknown tier takes the moderate route."""
    key = F.when(F.col(tier).isin(V.TIERS), F.col(tier)).otherwise("moderate")
    r = route_table.withColumnRenamed("tier", "__tier")
    return (df.withColumn("__key", key)
            .join(F.broadcast(r), F.col("__key") == F.col("__tier"), "left").drop("__key", "__tier"))


def override_routes(route_table: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides replace known tiers as a whole; unknown tiers are ignored, and of repeated ones the largest is taken."""
    o = (overrides.where(F.col("tier").isin(V.TIERS)).groupBy("tier")
         .agg(F.max(F.struct("model", "provider", "max_tokens")).alias("o")))  # a row per tier, so small
    names = ["model", "provider", "max_tokens"]
    return (route_table.join(F.broadcast(o), "tier", "left")
            .select("tier", *[F.when(F.col("o").isNotNull(), F.col("o")[n]).otherwise(F.col(n)).alias(n)
                              for n in names]))


def score_prompts(df: DataFrame, route_table: DataFrame | None = None, text: str = "text",
                  weights=V.CASCADE_WEIGHTS, include_features: bool = False) -> DataFrame:
    """Features, cascade score and route of each prompt. Narrow: no shuffle."""
    cols = df.columns
    scored = S.cascade_score(X.prompt_features(df, text), weights)
    routed = route(scored, route_table if route_table is not None else routes(df.sparkSession))
    extra = X.PROMPT_FEATURES if include_features else []
    return routed.select(*cols, "tier", "confidence", "score", "method", "model", "provider",
                         "max_tokens", *extra)


def escalate(df: DataFrame, min_conf: float = 0.8, min_quality: float = 0.7,
             tier: str = "tier", confidence: str = "confidence",
             quality: str | None = None) -> DataFrame:
    """One tier up when the score is unsure, or when the answer was poor."""
    weak = F.col(confidence) <= min_conf
    if quality:
        weak = weak | F.coalesce(F.col(quality) < min_quality, F.lit(False))
    up = S.tier_at(S.tier_index(F.col(tier)) + F.when(weak, 1).otherwise(0))
    return df.withColumn("safe_tier", up)


def resolve_provider(model: Column, agent_provider: Column) -> tuple[Column, Column]:
    """(provider, model without its provider prefix)."""
    pick, name = F.when(F.lit(False), ""), model
    for p in ["openrouter", "bailian", "zai"]:
        pick = pick.when(model.startswith(p + "/"), p)
        name = F.when(model.startswith(p + "/"), F.regexp_replace(model, f"^{p}/", "")).otherwise(name)
    provider = (pick.when(model.startswith("glm-"), "zai")
                .when(model.startswith("qwen") | model.startswith("kimi") | model.startswith("MiniMax"),
                      "bailian")
                .when(agent_provider.isin("bailian", "zai", "openrouter"), agent_provider)
                .otherwise("bailian"))
    known = model.rlike("^(?:openrouter|bailian|zai)/|^(?:glm-|qwen|kimi|MiniMax)")
    return provider, F.when(~known & (agent_provider == "openrouter"),
                            F.concat(F.lit("openrouter/"), model)).otherwise(name)


def profile_routes(spark) -> DataFrame:
    return dimension(spark, ["profile", "tier", "model"],
                     [(p, t, m) for p, ms in V.AGENT_PROFILES.items() for t, m in zip(V.TIERS, ms)])


def join_agents(df: DataFrame, agents: DataFrame, key: str = "agent_key",
                default_agent: tuple[str, str, str] = ("default", "moa", "balanced")) -> DataFrame:
    """Agent of a key, the default agent (id, provider, profile) when the key is unknown.
    The registry grows with the data, so the join carries no hint: Spark broadcasts it by
    measured size and otherwise joins by shuffle."""
    names = ["agent_id", "provider", "profile"]
    a = agents.select(F.col(key).alias("__k"), F.struct(*names).alias("__a"))
    default = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, default_agent)])
    return (df.join(a, F.col(key) == F.col("__k"), "left")
            .withColumn("__x", F.coalesce("__a", default))
            .select(*df.columns, F.col("__x.agent_id").alias("agent_id"),
                    F.col("__x.provider").alias("agent_provider"), F.col("__x.profile").alias("profile")))


def route_by_agent(df: DataFrame, spark, tier: str = "tier") -> DataFrame:
    """Model of the agent's profile and tier, with the provider rules applied."""
    known = list(V.AGENT_PROFILES)
    d = (df.withColumn("__p", F.when(F.col("profile").isin(known), F.col("profile")).otherwise("balanced"))
         .withColumn("__t", F.when(F.col(tier).isin(V.TIERS), F.col(tier)).otherwise("moderate")))
    r = profile_routes(spark).select(F.col("profile").alias("__rp"), F.col("tier").alias("__rt"),
                                     F.col("model").alias("__m"))
    j = d.join(F.broadcast(r), (F.col("__p") == F.col("__rp")) & (F.col("__t") == F.col("__rt")), "left")
    provider, model = resolve_provider(F.col("__m"), F.col("agent_provider"))
    return j.select(*df.columns, provider.alias("provider"), model.alias("model"))


def pricing(spark, rows=V.PRICING) -> DataFrame:
    return dimension(spark, ["price_model", "price_in", "price_out"], rows)


def join_pricing(df: DataFrame, prices: DataFrame, model: str = "routed_model") -> DataFrame:
    """Exact model, else without its ``openrouter/`` prefix, else with it, else free."""
    prefix = "openrouter/"
    keys = [F.col(model),
            F.when(F.col(model).startswith(prefix), F.regexp_replace(F.col(model), f"^{prefix}", "")),
            F.when(~F.col(model).startswith(prefix), F.concat(F.lit(prefix), F.col(model)))]
    d = df
    for i, k in enumerate(keys):
        p = prices.select(F.col("price_model").alias(f"__k{i}"),
                          F.struct("price_in", "price_out").alias(f"__p{i}"))
        d = d.join(F.broadcast(p), k == F.col(f"__k{i}"), "left")
    hit = F.coalesce("__p0", "__p1", "__p2")
    return (d.withColumn("__p", hit)
            .select(*df.columns, F.coalesce(F.col("__p.price_in"), F.lit(0.0)).alias("price_in"),
                    F.coalesce(F.col("__p.price_out"), F.lit(0.0)).alias("price_out"),
                    F.col("__p").isNotNull().alias("priced")))


def request_cost(df: DataFrame, prices: DataFrame, model: str = "routed_model",
                 baseline: tuple[float, float] | None = None) -> DataFrame:
    base = baseline or next((i, o) for m, i, o in V.PRICING if m == V.BASELINE_MODEL)
    j = join_pricing(df, prices, model)
    cin, cout = F.col("tokens_in") / F.lit(1e6), F.col("tokens_out") / F.lit(1e6)
    return (j.withColumn("cost_usd", cin * F.col("price_in") + cout * F.col("price_out"))
            .withColumn("baseline_cost_usd", cin * base[0] + cout * base[1])
            .withColumn("savings_usd", F.col("baseline_cost_usd") - F.col("cost_usd"))
            .withColumn("savings_pct", F.when(F.col("baseline_cost_usd") > 0,
                        F.col("savings_usd") / F.col("baseline_cost_usd") * 100).otherwise(0.0))
            .drop("price_in", "price_out"))


def resolve_fallbacks(attempts: DataFrame, chain: DataFrame, key: str = "interaction_id",
                      tier: str = "predicted_tier") -> DataFrame:
    """First attempt in chain order that did not call for a retry. Attempts beyond the
    tier's chain do not count; without a terminal attempt the request is unavailable."""
    status = F.col("status")
    retry = status.isin(V.RETRYABLE_STATUS) | status.rlike("^5[0-9][0-9]$")
    c = chain.select(F.col("tier").alias("__t"), F.col("pos").alias("__p"), "model", "provider")
    j = attempts.join(F.broadcast(c), (F.col(tier) == F.col("__t")) & (F.col("pos") == F.col("__p")))
    first = F.min(F.when(~retry, F.struct("pos", "status", "model", "provider"))).alias("f")
    return (j.groupBy(key, tier).agg(first, F.count(F.lit(1)).alias("chain_length"))
            .select(key, tier, F.col("f.pos").alias("pos"), F.col("f.model").alias("model"),
                    F.col("f.provider").alias("provider"),
                    F.when(F.col("f").isNull(), "unavailable").when(F.col("f.status") == "200", "success")
                    .otherwise("error").alias("outcome"),
                    F.coalesce(F.col("f.pos") + 1, F.col("chain_length")).alias("tried")))


def context_windows(spark) -> DataFrame:
    kv = dict(V.KV_BYTES_PER_1K)
    names = list(dict.fromkeys([m for m, _ in V.CONTEXT_WINDOWS] + list(kv)))
    win = dict(V.CONTEXT_WINDOWS)
    return dimension(spark, ["wm", "win", "kv"],
                     [(m, win.get(m, V.DEFAULT_WINDOW), kv.get(m, V.DEFAULT_KV_BYTES)) for m in names])


def with_window(df: DataFrame, model: str = "model") -> DataFrame:
    """Context window and KV bytes per 1000 tokens of the model."""
    w = context_windows(df.sparkSession)
    return (df.join(F.broadcast(w), F.col(model) == F.col("wm"), "left")
            .select(*df.columns, F.coalesce("win", F.lit(V.DEFAULT_WINDOW)).alias("context_window"),
                    F.coalesce("kv", F.lit(V.DEFAULT_KV_BYTES)).alias("kv_per_1k")))


def kv_bytes(tokens: Column, per_1k: Column) -> Column:
    return F.floor(tokens / F.lit(1000.0) * per_1k + 0.5).cast("long")


def compaction_threshold(window: Column) -> Column:
    return (F.when(window < 100000, F.floor(window * 0.8)).when(window > 500000, 450000)
            .otherwise(F.floor(window * 0.9))).cast("long")

"""Queries over prompts: features, text projections, scores and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions.num import rnd
from tierflow.functions import features as X, scoring as S, text as T
from tierflow.operators import routing as R
from tierflow.operators.scale import dimension, running
from tierflow.plans import sql as Q
from tierflow.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def rounded(df, names, digits=6):
    for n in names:
        df = df.withColumn(n, rnd(F.col(n).cast("double"), digits))
    return df


def _r(names, n=6):
    return ",".join(f"round(CAST({c} AS DOUBLE),{n}) AS {c}" for c in names)


# --- features -------------------------------------------------------------------
@query("f1_prompt_features",
       f"WITH {Q.PROMPTS}, {Q.f1()} SELECT id, {_r(X.PROMPT_FEATURES, 3)} FROM f1")
def f1(spark, sf):
    d = X.prompt_features(A.prompts(spark, sf)).drop("text")
    return rounded(d, X.PROMPT_FEATURES, 3)


@query("f1_prompt_features_raw",
       f"WITH {Q.PROMPTS}, {Q.f1(rounded=False)} SELECT id, {_r(X.PROMPT_FEATURES)} FROM f1")
def f1_raw(spark, sf):
    return rounded(X.prompt_features(A.prompts(spark, sf), rounded=False).drop("text"), X.PROMPT_FEATURES)


@query("f2_sample_features", f"WITH {Q.PROMPTS}, {Q.f2()} SELECT * EXCLUDE (text) FROM f2")
def f2(spark, sf):
    return X.sample_features(A.prompts(spark, sf)).drop("text")


@query("f3_feedback_features", f"WITH {Q.PROMPTS}, {Q.f3()} SELECT * EXCLUDE (text) FROM f3")
def f3(spark, sf):
    return X.feedback_features(A.prompts(spark, sf)).drop("text")


_LABELLED = "labelled AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'trivial' ELSE 'light' END AS label FROM prompts)"


@query("f4_generator_features",
       f"WITH {Q.PROMPTS}, {_LABELLED}, {Q.f4('labelled')} SELECT * EXCLUDE (text, label) FROM f4")
def f4(spark, sf):
    d = A.prompts(spark, sf).withColumn("label", F.when(F.col("id") % 2 == 0, "trivial").otherwise("light"))
    return X.generator_features(d).drop("text", "label")


@query("f5_gateway_features",
       f"WITH {Q.PROMPTS}, {Q.f5()} SELECT id, ws_words, {_r(X.GATEWAY_FEATURES)} FROM f5")
def f5(spark, sf):
    return rounded(X.gateway_features(A.prompts(spark, sf)).drop("text"), X.GATEWAY_FEATURES)


for _v in ("voter", "retrain"):
    @query(f"f6_cascade_features_{_v}",
           f"WITH {Q.PROMPTS}, {Q.f6(variant=_v)} SELECT id, {_r(V.FEATURE_NAMES)} FROM f6")
    def f6(spark, sf, v=_v):
        return rounded(X.cascade_features(A.prompts(spark, sf), variant=v).drop("text"), V.FEATURE_NAMES)


@query("f7_vector", f"""WITH {Q.PROMPTS}, {Q.f1()}, v AS (SELECT id, unnest([
  {','.join('0::DOUBLE' if n == 'code' else n for n in V.FEATURE_NAMES)}]) AS value, unnest(range(15)) AS slot FROM f1)
  SELECT id, slot::BIGINT AS slot, round(value,3) AS value FROM v""")
def f7(spark, sf):
    d = X.prompt_features(A.prompts(spark, sf)).select("id", F.posexplode(X.to_vector()).alias("slot", "value"))
    return d.select("id", F.col("slot").cast("long").alias("slot"), rnd("value", 3).alias("value"))


@query("f8_signal_count", f"WITH {Q.PROMPTS}, {Q.f8()} SELECT * EXCLUDE (text) FROM f8")
def f8(spark, sf):
    return X.signal_count(A.prompts(spark, sf)).drop("text")


@query("f9_prompt_keywords", f"""WITH {Q.PROMPTS}
  SELECT id, array_to_string({Q.kw('text', True)},' ') AS distinct_keywords,
  array_to_string({Q.kw('text', False)},' ') AS plain_keywords,
  array_to_string({Q.kw('text', True, V.STOP_PREFIXES_LONG)},' ') AS long_stop_keywords FROM prompts""")
def f9(spark, sf):
    t = F.col("text")
    return A.prompts(spark, sf).select(
        "id", F.array_join(T.keywords(t), " ").alias("distinct_keywords"),
        F.array_join(T.keywords(t, False), " ").alias("plain_keywords"),
        F.array_join(T.keywords(t, True, V.STOP_PREFIXES_LONG), " ").alias("long_stop_keywords"))


# --- text projections -----------------------------------------------------------
@query("t1_prompt_hash", f"""WITH {Q.PROMPTS} SELECT id, substr(sha256(text),1,16) AS hash,
  'sha256:'||substr(sha256(text),1,16) AS logged_hash FROM prompts""")
def t1(spark, sf):
    t = F.col("text")
    return A.prompts(spark, sf).select("id", T.prompt_hash(t).alias("hash"),
                                       T.prompt_hash(t, "sha256:").alias("logged_hash"))


@query("t2_sample_id", f"""WITH {Q.PROMPTS} SELECT id,
  'gpd_syn_'||substr(md5('synthetic:'||id||':'||substr(text,1,100)),1,12) AS sample_id,
  'ws_'||substr(md5('docs/'||id||'.md'),1,8)||'_'||lpad(CAST(id % 10000 AS VARCHAR),4,'0') AS file_id FROM prompts""")
def t2(spark, sf):
    return A.prompts(spark, sf).select(
        "id", T.sample_id(F.lit("synthetic"), F.col("id"), F.col("text")).alias("sample_id"),
        T.file_sample_id(F.concat(F.lit("docs/"), F.col("id").cast("string"), F.lit(".md")),
                         F.col("id") % 10000).alias("file_id"))


@query("t3_safe_summary", f"""WITH {Q.PROMPTS}, m AS (SELECT id, regexp_replace(text,
  '(api_key|password|token|secret|key)[=:]\\s*\\S+', '\\1=***REDACTED***', 'gi') AS t FROM prompts)
  SELECT id, substr(t,1,500) AS summary, substr(t,1,200) AS short_summary FROM m""")
def t3(spark, sf):
    return A.prompts(spark, sf).select("id", T.safe_summary(F.col("text")).alias("summary"),
                                       T.safe_summary(F.col("text"), 200).alias("short_summary"))


@query("t4_est_tokens", f"""WITH {Q.MESSAGES} SELECT session_id, pos,
  CAST(ceil((length(text)+coalesce(length(calls[1])+11,0))/4.0::DOUBLE) AS BIGINT)+10 AS tokens FROM messages""")
def t4(spark, sf):
    return A.messages(spark, sf).select("session_id", "pos", T.est_tokens(
        F.col("text"), F.coalesce(F.length(F.to_json("tool_calls")), F.lit(0))).alias("tokens"))


_MODELS = ["qwen3.6-plus", "glm-4.7", "unlisted-model", "openrouter/owl-alpha", "glm-5.1"]


def _win(col, pairs, default):
    return Q.case_map(col, [(k, float(v)) for k, v in pairs], float(default))


@query("t5_kv_and_threshold", f"""WITH {Q.PROMPTS}, m AS (SELECT ({Q.lst(_MODELS)})[CAST(id % 5 AS INT)+1] AS model,
    CAST(ceil(length(text)/4.0::DOUBLE) AS BIGINT)+10 AS tokens FROM prompts),
  w AS (SELECT *, CAST({_win('model', V.CONTEXT_WINDOWS, V.DEFAULT_WINDOW)} AS BIGINT) AS win,
    {_win('model', V.KV_BYTES_PER_1K, V.DEFAULT_KV_BYTES)} AS kv FROM m)
  SELECT model, count(*) AS n, CAST(sum(CAST(floor(tokens/1000.0::DOUBLE*kv+0.5) AS BIGINT)) AS BIGINT) AS kv_bytes,
    max(win) AS context_window, max(CASE WHEN win < 100000 THEN CAST(floor(win*0.8::DOUBLE) AS BIGINT)
      WHEN win > 500000 THEN 450000 ELSE CAST(floor(win*0.9::DOUBLE) AS BIGINT) END) AS threshold FROM w GROUP BY model""")
def t5(spark, sf):
    d = A.prompts(spark, sf).select(
        F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("id") % 5 + 1).cast("int")).alias("model"),
        T.est_tokens(F.col("text")).alias("tokens"))
    d = R.with_window(d)
    return d.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(R.kv_bytes(F.col("tokens"), F.col("kv_per_1k"))).alias("kv_bytes"),
        F.max("context_window").alias("context_window"),
        F.max(R.compaction_threshold(F.col("context_window"))).alias("threshold"))


@query("t6_topic_tags", f"""WITH {Q.PROMPTS} SELECT id, array_to_string({Q.tags('text')},',') AS tags,
  least(1.0::DOUBLE, len({Q.tags('text')})/4.0::DOUBLE) AS importance FROM prompts""")
def t6(spark, sf):
    d = A.prompts(spark, sf).withColumn("t", T.topic_tags(F.col("text")))
    return d.select("id", F.array_join("t", ",").alias("tags"),
                    T.semantic_importance(F.col("t")).alias("importance"))


_DEC = [r"(?i)(?:decision|conclusion|therefore|resolved|agreed|final)[:\s]*([^\n]+)",
        r"(?i)(?:the answer is|key point|important|note that)[:\s]*([^\n]+)"]


def _decisions(col):
    parts = [f"regexp_extract_all({col},{Q.s(p)},1)" for p in _DEC]
    return f"list_transform(list_concat({parts[0]},{parts[1]}), lambda d: substr({Q.strip('d')},1,150))"


@query("t7_key_decisions", f"""WITH {Q.MESSAGES}, d AS (SELECT session_id, pos, unnest(l) AS decision,
    generate_subscripts(l,1) AS n FROM (SELECT session_id, pos, {_decisions('text')} AS l FROM messages))
  SELECT session_id, pos, CAST(n AS BIGINT) AS n, decision FROM d""")
def t7(spark, sf):
    return (A.messages(spark, sf).select("session_id", "pos", T.key_decisions(F.col("text")).alias("l"))
            .select("session_id", "pos", F.posexplode("l").alias("n0", "decision"))
            .select("session_id", "pos", (F.col("n0") + 1).cast("long").alias("n"), "decision"))


@query("t8_chunk_text", f"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(length(text) AS BIGINT),1), 3500)) AS start FROM documents),
  c AS (SELECT doc_id, start, substr(text, start+1, 4000) AS raw FROM w),
  k AS (SELECT doc_id, start, {Q.strip('raw')} AS chunk FROM c WHERE length(raw) > 50 AND {Q.strip('raw')} <> ''),
  f AS (SELECT doc_id, 0 AS start, substr(text,1,4000) AS chunk FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start)-1 AS BIGINT) AS chunk_pos, md5(chunk) AS chunk_md5
  FROM (SELECT * FROM k UNION ALL SELECT * FROM f)""")
def t8(spark, sf):
    d = T.chunk_text(A.text_table(spark, sf, "documents").select("doc_id", "text"), kind="window", minimum=50)
    return d.select("doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), F.md5("chunk").alias("chunk_md5"))


@query("t8_chunk_by_suffix")
def t8_code(spark, sf):
    """Pages as mixed files: code, markdown and plain windows by suffix."""
    d = A.text_table(spark, sf, "pages").select(
        "page_id", F.element_at(F.array(F.lit(".py"), F.lit(".md"), F.lit(".html")),
                                (F.col("page_id") % 3 + 1).cast("int")).alias("suffix"),
        F.regexp_replace("html", "(?i)<h[1-3]", "\n## x <h").alias("text"))
    c = T.chunk_text(d, suffix="suffix")
    return c.groupBy("suffix").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query("t9_last_user_prompt", """SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations
  WHERE role='user' GROUP BY conv_id""")
def t9(spark, sf):
    """Typed blocks are joined; thinking blocks are no text."""
    d = A.text_table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", T.block_text(F.array(
            F.struct(F.lit("thinking").alias("type"), F.lit("...").alias("text")),
            F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).alias("text"))
    return d.groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"))


_VRE = (r"(?i)^(✅|yes|correct|👍|❌|no|wrong|nah)\s*(trivial|light|moderate|heavy|intensive|extreme)?$")


@query("t10_parse_vote_reply", f"""WITH {Q.VOTES}, p AS (SELECT reply_id, lower(regexp_extract(trim(reply_text),{Q.s(_VRE)},1)) AS m,
    nullif(lower(regexp_extract(trim(reply_text),{Q.s(_VRE)},2)),'') AS t FROM replies)
  SELECT reply_id, CASE WHEN m='' THEN NULL ELSE m IN ('✅','yes','correct','👍') AND t IS NULL END AS agreed, t AS correct_tier FROM p""")
def t10(spark, sf):
    agreed, tier = T.parse_vote_reply(F.col("reply_text"))
    return A.vote_replies(spark, sf).select("reply_id", agreed.alias("agreed"), tier.alias("correct_tier"))


@query("t11_resolve_provider", f"""WITH {Q.INTERACTIONS}, m AS (SELECT interaction_id,
   (['openrouter/owl-alpha','bailian/qwen3.5-plus','glm-4.7','kimi-k2.5','MiniMax-M2.5','zai/glm-5.1','other-model'])[CAST(interaction_id % 7 AS INT)+1] AS raw,
   (['bailian','zai','openrouter','moa'])[CAST(interaction_id % 4 AS INT)+1] AS ap FROM interactions)
  SELECT interaction_id, CASE WHEN starts_with(raw,'openrouter/') THEN 'openrouter' WHEN starts_with(raw,'bailian/') THEN 'bailian'
    WHEN starts_with(raw,'zai/') THEN 'zai' WHEN starts_with(raw,'glm-') THEN 'zai'
    WHEN regexp_matches(raw,'^(qwen|kimi|MiniMax)') THEN 'bailian' WHEN ap IN ('bailian','zai','openrouter') THEN ap ELSE 'bailian' END AS provider,
    CASE WHEN regexp_matches(raw,'^(openrouter|bailian|zai)/') THEN regexp_replace(raw,'^(openrouter|bailian|zai)/','')
      WHEN regexp_matches(raw,'^(glm-|qwen|kimi|MiniMax)') THEN raw WHEN ap='openrouter' THEN 'openrouter/'||raw ELSE raw END AS model FROM m""")
def t11(spark, sf):
    names = ["openrouter/owl-alpha", "bailian/qwen3.5-plus", "glm-4.7", "kimi-k2.5", "MiniMax-M2.5",
             "zai/glm-5.1", "other-model"]
    d = A.interactions(spark, sf).select(
        "interaction_id", F.element_at(F.array(*[F.lit(n) for n in names]),
                                       (F.col("interaction_id") % 7 + 1).cast("int")).alias("raw"),
        F.element_at(F.array(*[F.lit(n) for n in ["bailian", "zai", "openrouter", "moa"]]),
                     (F.col("interaction_id") % 4 + 1).cast("int")).alias("ap"))
    provider, model = R.resolve_provider(F.col("raw"), F.col("ap"))
    return d.select("interaction_id", provider.alias("provider"), model.alias("model"))


@query("t13_notes", f"""WITH {Q.MESSAGES}, d AS (SELECT session_id, pos, role, text, {_decisions('text')} AS l FROM messages)
  SELECT session_id, pos, CASE WHEN len(l)>0 THEN chr(10)||chr(10)||'Continuity from previous turn (heavy→glm-5.1):'||chr(10)||
    array_to_string(list_transform(list_slice(l, greatest(len(l)-2,1), len(l)), lambda x: '- '||x), chr(10)) END AS continuity,
    '[Retrieved context from '||role||': '||substr(text,1,200)||']' AS context FROM d""")
def t13(spark, sf):
    return A.messages(spark, sf).withColumn("l", T.key_decisions(F.col("text"))).select(
        "session_id", "pos", T.continuity_note(F.col("l"), F.lit("heavy"), F.lit("glm-5.1")).alias("continuity"),
        T.context_note(F.col("role"), F.substring("text", 1, 200)).alias("context"))


# --- scores, tiers, routes --------------------------------------------------------
@query("x1_heuristic_score", f"WITH {Q.PROMPTS}, {Q.f1()} SELECT id, {Q.rnd(Q.heuristic())} AS score FROM f1")
def x1(spark, sf):
    return X.prompt_features(A.prompts(spark, sf)).select("id", rnd(S.heuristic_score(), 6).alias("score"))


@query("x2_tier_classic", f"""WITH {Q.PROMPTS}, {Q.f1()}, h AS (SELECT {Q.heuristic()} AS score FROM f1)
  SELECT {Q.tier_of('score', V.CLASSIC_BOUNDS)} AS tier, count(*) AS n, round(avg(score),6) AS mean_score FROM h GROUP BY 1""")
def x2(spark, sf):
    d = X.prompt_features(A.prompts(spark, sf)).select(S.heuristic_score().alias("score"))
    return d.groupBy(S.tier_classic(F.col("score")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("score"), 6).alias("mean_score"))


@query("x3_tier_calibrated", f"""WITH {Q.PROMPTS}, {Q.f5()}, h AS (SELECT {Q.GATEWAY_HEURISTIC} AS score FROM f5)
  SELECT {Q.tier_of('score', V.CALIBRATED_BOUNDS)} AS tier, {Q.tier_of('score', [.1, .2, .3, .4, .5])} AS custom_tier,
  count(*) AS n FROM h GROUP BY 1, 2""")
def x3(spark, sf):
    d = X.gateway_features(A.prompts(spark, sf)).select(S.gateway_heuristic().alias("score"))
    return d.groupBy(S.tier_calibrated(F.col("score")).alias("tier"),
                     S.tier_calibrated(F.col("score"), [.1, .2, .3, .4, .5]).alias("custom_tier")).count() \
        .withColumnRenamed("count", "n")


@query("x4_signal_score", f"""WITH {Q.PROMPTS}, {Q.f8()} SELECT id, {Q.rnd(Q.clamp(Q.RAW_SIGNAL))} AS score,
  {Q.tier_of(Q.RAW_SIGNAL, V.CALIBRATED_BOUNDS)} AS tier FROM f8""")
def x4(spark, sf):
    return S.signal_score(A.prompts(spark, sf)).select("id", rnd("score", 6).alias("score"), "tier")


@query("x5_gateway_heuristic", f"WITH {Q.PROMPTS}, {Q.f5()} SELECT id, {Q.rnd(Q.GATEWAY_HEURISTIC)} AS score FROM f5")
def x5(spark, sf):
    return X.gateway_features(A.prompts(spark, sf)).select("id", rnd(S.gateway_heuristic(), 6).alias("score"))


@query("x6_cascade_score", f"WITH {Q.PROMPTS}, {Q.f1()}, {Q.cascade()} SELECT id, score, confidence, tier FROM casc")
def x6(spark, sf):
    return S.cascade_score(X.prompt_features(A.prompts(spark, sf))).select("id", "score", "confidence", "tier")


@query("x6_heuristic_fallback", f"""WITH {Q.PROMPTS}, {Q.f1()}, h AS (SELECT id, {Q.heuristic()} AS score FROM f1)
  SELECT id, round(score,6) AS score, {Q.even('score', 4)} AS confidence, {Q.tier_of('score', V.CLASSIC_BOUNDS)} AS tier FROM h""")
def x6_fallback(spark, sf):
    d = S.cascade_score(X.prompt_features(A.prompts(spark, sf)), weights={})
    return d.select("id", rnd("score", 6).alias("score"), "confidence", "tier")


def _first_yes(pairs, default):
    import math
    return "(CASE " + " ".join(f"WHEN 1.0/(1.0+exp(-{Q.logit(t)})) > {p} THEN '{t}'" for t, p in pairs) + f" ELSE '{default}' END)"


@query("x7_cascade_first_yes", f"""WITH {Q.PROMPTS}, {Q.f1(rounded=False)} SELECT id,
  {_first_yes([(t, .5) for t in V.CASCADE_TIERS], 'extreme')} AS tier FROM f1""")
def x7(spark, sf):
    return X.prompt_features(A.prompts(spark, sf), rounded=False).select("id", S.first_yes().alias("tier"))


@query("x8_sigmoid_score", f"""WITH {Q.PROMPTS}, {Q.f6()} SELECT id,
  round(1.0/(1.0+exp(-({'+'.join(f'{n}*({w!r}::DOUBLE)' for n, w in zip(V.FEATURE_NAMES, V.CASCADE_WEIGHTS['moderate'][1]))}))),6) AS score FROM f6""")
def x8(spark, sf):
    d = X.cascade_features(A.prompts(spark, sf))
    return d.select("id", rnd(S.sigmoid_score(V.CASCADE_WEIGHTS["moderate"][1]), 6).alias("score"))


_ROUTES = Q.values("routes", "tier,model,provider,max_tokens", [r[:4] for r in V.DEFAULT_ROUTES])


@query("x9_route", f"""WITH {Q.INTERACTIONS}, {_ROUTES},
  t AS (SELECT CASE WHEN interaction_id % 7 = 0 THEN 'unknown' ELSE predicted_tier END AS tier FROM interactions)
  SELECT t.tier, r.model, r.provider, r.max_tokens, count(*) AS n FROM t
  JOIN routes r ON r.tier = CASE WHEN t.tier='unknown' THEN 'moderate' ELSE t.tier END GROUP BY 1,2,3,4""")
def x9(spark, sf):
    d = A.interactions(spark, sf).select(
        F.when(F.col("interaction_id") % 7 == 0, "unknown").otherwise(F.col("predicted_tier")).alias("tier"))
    return R.route(d, R.routes(spark)).groupBy("tier", "model", "provider", "max_tokens").count() \
        .withColumnRenamed("count", "n")


@query("x10_score_and_route", f"""WITH {Q.PROMPTS}, {Q.f1()}, {Q.cascade()}, {_ROUTES}
  SELECT c.id, c.tier, c.confidence, c.score, 'cascade' AS method, r.model, r.provider, r.max_tokens
  FROM casc c JOIN routes r USING (tier)""")
def x10(spark, sf):
    return R.score_prompts(A.prompts(spark, sf)).drop("text")


@query("x19_gated_route", f"""WITH {Q.PROMPTS}, {Q.f1()} SELECT id, {_first_yes(V.PROBABILITY_GATES, 'intensive')} AS tier,
  {_first_yes(V.DOWNGRADE_GATES, 'extreme')} AS downgrade_tier FROM f1""")
def x19(spark, sf):
    d = X.prompt_features(A.prompts(spark, sf))
    return d.select("id", S.gated_tier().alias("tier"),
                    S.gated_tier(gates=V.DOWNGRADE_GATES, default="extreme").alias("downgrade_tier"))


@query("x20_tier_value", f"""WITH {Q.INTERACTIONS} SELECT interaction_id, {Q.midpoint('actual_tier')} AS midpoint,
  {Q.case_map('actual_tier', V.RETRIEVAL_TIER_VALUES.items(), 0.3)} AS retrieval_value FROM interactions""")
def x20(spark, sf):
    return A.interactions(spark, sf).select(
        "interaction_id", S.tier_value(F.col("actual_tier")).alias("midpoint"),
        S.tier_value(F.col("actual_tier"), V.RETRIEVAL_TIER_VALUES, 0.3).alias("retrieval_value"))


@query("x21_escalate", f"""WITH {Q.PROMPTS}, {Q.f1()}, {Q.cascade()}, q AS (SELECT *, (id % 10)/10.0::DOUBLE AS quality FROM casc)
  SELECT id, {Q.tier_at(f"least({Q.tier_idx('tier')} + (confidence <= 0.8 OR quality < 0.7)::INT, 5)")} AS safe_tier,
  {Q.tier_at(f"least({Q.tier_idx('tier')} + (confidence <= 0.8)::INT, 5)")} AS safe_by_confidence FROM q""")
def x21(spark, sf):
    d = S.cascade_score(X.prompt_features(A.prompts(spark, sf))).withColumn("quality", F.col("id") % 10 / 10.0)
    d = R.escalate(d).withColumnRenamed("safe_tier", "safe_by_confidence")
    return R.escalate(d, quality="quality").select("id", "safe_tier", "safe_by_confidence")


def _label_sql():
    conds = ["contains(text,'?')", Q.has("low", V.LABEL_CODE), Q.rx("low", "^" + Q.alt(V.SIGNAL_IMPERATIVES) + " "),
             Q.rx("text", r"[0-9]+[\s]*[+\-*/=]"), Q.has("low", V.LABEL_SEQUENCE), Q.has("low", V.LABEL_CONSTRAINT),
             Q.has("low", V.LABEL_CONTEXT), Q.has("low", V.SIGNAL_ARCHITECTURE), Q.has("low", V.SIGNAL_DESIGN)]
    return (f"(({'+'.join(c + '::INT' for c in conds)})*0.15::DOUBLE + ln(1+{Q.ws_words('text')}::DOUBLE)*0.08::DOUBLE"
            f" + (CASE WHEN {Q.has('low', V.LABEL_CONTEXT)} THEN 0.1 ELSE 0 END)::DOUBLE)")


LABEL_SQL = (f"l1_t AS (SELECT *, lower(text) AS low FROM prompts), l1_s AS (SELECT *, {_label_sql()} AS ls FROM l1_t), "
             f"l1 AS (SELECT id, text, {Q.tier_of('ls', V.LABEL_BOUNDS)} AS label FROM l1_s)")


@query("l1_label_signals", f"WITH {Q.PROMPTS}, {LABEL_SQL} SELECT id, label FROM l1")
def l1(spark, sf):
    return S.label_signals(A.prompts(spark, sf)).select("id", "label")


RULES_SQL = """(CASE WHEN word_count<50 AND NOT has_code AND technical_terms=0 AND NOT multi_step THEN 'trivial'
  WHEN architecture AND technical_design AND multi_step THEN 'extreme'
  WHEN architecture AND (multi_step OR requires_context) THEN 'intensive'
  WHEN word_count>300 AND (multi_step OR technical_design) THEN 'heavy'
  WHEN has_code OR technical_terms>=3 THEN 'moderate'
  WHEN word_count<200 AND NOT multi_step AND NOT architecture AND technical_terms<=2 THEN 'light' ELSE 'moderate' END)"""


@query("l2_label_rules", f"""WITH {Q.PROMPTS}, p AS (SELECT *, CASE WHEN id % 10 = 9 THEN 'heavy' END AS given FROM prompts), {Q.f2('p')}
  SELECT id, coalesce(given, {RULES_SQL}) AS label, CASE WHEN given IS NULL THEN 0.85 ELSE 1 END::DOUBLE AS confidence FROM f2""")
def l2(spark, sf):
    d = A.prompts(spark, sf).withColumn("label", F.when(F.col("id") % 10 == 9, "heavy"))
    return S.label_missing(d).select("id", "label", "confidence")


# --- responses --------------------------------------------------------------------
def _responses(spark, sf):
    return A.responses(spark, sf).withColumn("predicted_tier", S.tier_at(F.col("predicted_idx")))


def assess_sql(src):
    p, p0 = Q.midpoint("predicted_tier"), Q.midpoint("predicted_tier", 0.0)
    lad = ("(CASE WHEN w<30 THEN 'trivial' WHEN w<100 THEN 'light' WHEN w<300 THEN 'moderate' WHEN w<800 THEN 'heavy' "
           "WHEN w<2000 THEN 'intensive' ELSE 'extreme' END)")
    return f"""as_w AS (SELECT *, {Q.ws_words('response')} AS w FROM {src}),
as_e AS (SELECT *, {lad} AS ladder, {p} > 0.4 AND w < 50 AS ov, {p} < 0.2 AND (w > 500 OR latency_ms > 5000) AS un, {p0} AS p0 FROM as_w),
as_m AS (SELECT *, {Q.midpoint('ladder', 0.0)} AS est FROM as_e),
assessed AS (SELECT * EXCLUDE (p0, est, ladder, ov, un, w), w::BIGINT AS response_words,
  CASE WHEN ov THEN CASE WHEN w<20 THEN 'trivial' ELSE 'light' END WHEN un THEN CASE WHEN w<1000 THEN 'moderate' ELSE 'heavy' END ELSE ladder END AS actual_tier,
  round(CAST(CASE WHEN ov THEN 0.3 WHEN un THEN 0.4 ELSE greatest(0.0::DOUBLE, 1.0-abs(p0-est)*3.0) END AS DOUBLE),2) AS self_rating,
  CASE WHEN ov THEN true WHEN un THEN false ELSE p0 > est + 0.2::DOUBLE END AS was_overkill,
  CASE WHEN ov THEN false WHEN un THEN true ELSE p0 < est - 0.1::DOUBLE END AS was_underkill FROM as_m)"""


@query("x15_assess_response", f"""WITH {Q.RESPONSES}, {assess_sql('responses')}
  SELECT id, response_words, actual_tier, self_rating, was_overkill, was_underkill FROM assessed""")
def x15(spark, sf):
    return S.assess_response(_responses(spark, sf)).select(
        "id", "response_words", "actual_tier", "self_rating", "was_overkill", "was_underkill")


def quick_sql(src="responses"):
    lo = Q.case_map("predicted_tier", [(t, float(a)) for t, a, _ in V.ADEQUACY_TOKEN_RANGES], 50.0)
    hi = Q.case_map("predicted_tier", [(t, float(b)) for t, _, b in V.ADEQUACY_TOKEN_RANGES], 1000.0)
    return f"""qa_w AS (SELECT *, {Q.ws_list('lower(response)')} AS words, {lo} AS lo, {hi} AS hi FROM {src}),
qa_s AS (SELECT *, len(words) AS n, len(list_distinct(words))/greatest(len(words),1)::DOUBLE AS uniq FROM qa_w),
quick AS (SELECT id, predicted_tier, CASE WHEN id % 17 = 0 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE,
  (CASE WHEN tokens_out BETWEEN lo AND hi THEN 0.4::DOUBLE WHEN tokens_out < lo THEN greatest(0::DOUBLE,(tokens_out/lo)*0.4::DOUBLE) ELSE greatest(0.1::DOUBLE,(hi/tokens_out)*0.4::DOUBLE) END)
  + (CASE WHEN n > 5 AND n < 2000 THEN 0.2 WHEN n <= 5 THEN 0.05 ELSE 0.1 END)::DOUBLE
  + (CASE WHEN latency_ms > 30000 THEN 0.1 WHEN latency_ms < 200 AND predicted_tier <> 'trivial' THEN 0.05 ELSE 0.2 END)::DOUBLE
  + (CASE WHEN uniq > 0.7 THEN 0.2 WHEN uniq > 0.4 THEN 0.1 ELSE 0.05 END)::DOUBLE) END AS quick FROM qa_s)"""


def quick(spark, sf):
    d = _responses(spark, sf)
    return d.withColumn("quick", S.quick_adequacy(F.col("response"), F.col("predicted_tier"), F.col("tokens_out"),
                                                  F.col("latency_ms"), F.col("id") % 17 == 0))


@query("x16_quick_adequacy", f"WITH {Q.RESPONSES}, {quick_sql()} SELECT id, round(quick,6) AS quick FROM quick")
def x16(spark, sf):
    return quick(spark, sf).select("id", rnd("quick", 6).alias("quick"))


# --- route tables -----------------------------------------------------------------
_CHAIN = [(t, i, m, p, mt, th) for t, m0, p0, mt, th, fb in V.GATEWAY_ROUTES
          for i, (m, p) in enumerate([(m0, p0)] + [f for f in fb if f != (m0, p0)])]
CHAIN_SQL = Q.values("chain", "tier,pos,model,provider,max_tokens,thinking", _CHAIN)


@query("s10_tier_routes", f"""WITH {Q.INTERACTIONS}, {CHAIN_SQL} SELECT c.tier, c.pos, c.model, c.provider, c.max_tokens, c.thinking, count(*) AS n
  FROM interactions i JOIN chain c ON c.tier = i.predicted_tier GROUP BY ALL""")
def s10(spark, sf):
    d = A.interactions(spark, sf).groupBy(F.col("predicted_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(R.tier_routes(spark)), "tier").select(
        "tier", "pos", "model", "provider", "max_tokens", "thinking", "n")


_OVER = [("heavy", "custom-pro", "custom", 4096), ("no-such-tier", "x", "x", 1)]


@query("s11_override_routes", f"""WITH {Q.INTERACTIONS}, {_ROUTES}, {Q.values('ov', 'tier,model,provider,max_tokens', _OVER)},
  r AS (SELECT r.tier, CASE WHEN o.tier IS NULL THEN r.model ELSE o.model END AS model, CASE WHEN o.tier IS NULL THEN r.provider ELSE o.provider END AS provider,
    CASE WHEN o.tier IS NULL THEN r.max_tokens ELSE o.max_tokens END AS max_tokens FROM routes r LEFT JOIN ov o USING (tier))
  SELECT r.*, count(*) AS n FROM interactions i JOIN r ON r.tier=i.predicted_tier GROUP BY ALL""")
def s11(spark, sf):
    r = R.override_routes(R.routes(spark), dimension(spark, ["tier", "model", "provider", "max_tokens"], _OVER))
    d = A.interactions(spark, sf).groupBy(F.col("predicted_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return R.route(d, r).select("tier", "model", "provider", "max_tokens", "n")

"""Queries over files, model fitting and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import features as X, scoring as S, text as T
from tierflow.functions.num import rnd
from tierflow.operators import dataset as D, fit as M, retrieval as I, routing as R
from tierflow.operators.scale import dimension, scratch_dir, staged
from tierflow.plans import datasets as PD, feedback as PF, prompts as P, sql as Q
from tierflow.sources import adapters as A, files as S_
from tierflow.streaming import streams as Z

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# --- files ---------------------------------------------------------------------------------
@query("s1_read_prompts", f"""WITH d AS (SELECT *, doc_id%7 AS k FROM documents), g AS (SELECT {Q.strip('text')} AS text, CASE WHEN k=2 THEN 'heavy' END AS given,
    CASE WHEN k=2 THEN lang ELSE 'custom-jsonl' END AS src FROM d WHERE k IN (0,1,2,5)), prompts AS (SELECT row_number() OVER () AS id, text, given, src FROM g WHERE text<>''), {P.LABEL_SQL}
  SELECT md5(p.text) AS text_md5, coalesce(given,label) AS label, src AS source, count(*) AS n FROM prompts p JOIN l1 USING (id) GROUP BY ALL""")
def s1(spark, sf):
    """Good, blank, broken and text-less lines written out of documents, then read."""
    k = F.col("doc_id") % 7
    j = lambda *c: F.to_json(F.struct(*c))
    t = F.col("text")
    line = (F.when(k == 0, j(t.alias("text"))).when(k == 1, j(t.alias("prompt")))
            .when(k == 2, j(t.alias("instruction"), F.lit("heavy").alias("label"), F.col("lang").alias("source")))
            .when(k == 3, "").when(k == 4, F.concat(F.lit('{"text": "'), F.lit("broken")))
            .when(k == 5, j(F.lit("").alias("text"), t.alias("prompt"))).otherwise('{"other": 1}'))
    path = scratch_dir(spark)
    A.text_table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return S_.read_prompts(spark, path).groupBy(F.md5("text").alias("text_md5"), "label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("s2_read_score_input", f"""WITH l AS (SELECT CASE WHEN doc_id%2=0 THEN text ELSE {Q.strip("regexp_replace(text,'[\\r\\n]',' ','g')")} END AS text FROM documents) SELECT md5(text) AS text_md5, count(*) AS n FROM l WHERE text<>'' GROUP BY 1""")
def s2(spark, sf):
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("prompt")))) \
        .otherwise(F.regexp_replace("text", "[\r\n]", " "))
    path = scratch_dir(spark)
    A.text_table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return S_.read_score_input(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def _samples(spark, sf):
    d = S.label_signals(A.text_table(spark, sf, "documents").select("doc_id", "text", "source"))
    return d.select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("raw_text"),
                    F.create_map(F.lit("k"), F.lit("v")).alias("context"), F.col("label").alias("complexity_hint"),
                    F.lit("query").alias("intent_type"), F.lit("general").alias("domain"), "label",
                    F.lit(0.85).alias("confidence"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


_S3 = f"WITH prompts AS (SELECT doc_id AS id, text FROM documents), {P.LABEL_SQL} SELECT label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM l1 GROUP BY 1"


@query("s3_read_samples", _S3)
def s3(spark, sf):
    path = scratch_dir(spark)
    S_.write_jsonl(_samples(spark, sf), path)
    return S_.read_samples(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_text")).alias("chars"))


@query("s5_scan_corpus")
def s5(spark, sf):
    """Pages written as files in two folders, one of them excluded."""
    path = scratch_dir(spark)
    d = A.text_table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "[\r\n]", " ").alias("value"),
                                           F.when(F.col("page_id") % 5 == 0, "node_modules").otherwise("src").alias("folder"))
    for folder in ("src", "node_modules"):
        part = d.where(F.col("folder") == folder).repartition(8, F.col("page_id") % 8).sortWithinPartitions("page_id")
        part.select("value").write.text(f"{path}/{folder}")
    c = S_.scan_corpus(spark, path)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("raw_text")).alias("chars"))


@query("s6_session_turns", "SELECT 'sess_'||conv_id||'_'||lpad(CAST(turn AS VARCHAR),4,'0') AS id, md5(text) AS text_md5 FROM conversations WHERE role='user' AND length(text)>=10")
def s6(spark, sf):
    return S_.session_turns(A.text_table(spark, sf, "conversations")).select("id", F.md5("raw_text").alias("text_md5"))


@query("s7_write_jsonl", f"WITH {PD.LAB}, r AS ({PD._rank_sql('lab', 'label')}) SELECT CASE WHEN rk<=floor(tot*0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1")
def s7(spark, sf):
    path = scratch_dir(spark)
    d = D.stratified_split(staged(PD._labelled(spark, sf)))
    for part in ("train", "test"):
        S_.write_jsonl(d.where(F.col("part") == part), f"{path}/{part}")
    back = spark.read.schema(d.schema).json([f"{path}/train", f"{path}/test"])
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s8_cost_log", f"""WITH {Q.INTERACTIONS}, {PF.COSTS} SELECT predicted_tier, count(*) AS n, round(sum(cost_usd),8) AS cost FROM costs WHERE strftime(ts,'%Y-%m-%d')='2024-01-10' GROUP BY 1""")
def s8(spark, sf):
    """The whole log is written by day; one day is read back."""
    path = scratch_dir(spark)
    S_.write_cost_log(PF.costs(spark, sf), path)
    return S_.read_cost_log(spark, path, "2024-01-10").groupBy("predicted_tier").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("cost_usd"), 8).alias("cost"))


# --- fitting ---------------------------------------------------------------------------------
def _train(spark, sf):
    """Formula-labelled documents with generated trivial, light and graded prompts."""
    docs = S.label_signals(A.text_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    ids = PD._ids(spark, sf)
    gen = D.generate_prompts(ids).select((F.col("id") + 1000000000).alias("id"), "text", "label")
    graded = D.generate_graded(ids.select("id")).select((F.col("id") + 2000000000).alias("id"), "text", F.col("tier").alias("label"))
    return docs.unionByName(gen).unionByName(graded)


@query("m1_fit_binary")
def m1(spark, sf):
    d = X.prompt_features(_train(spark, sf)).select("id", X.to_vector().alias("vec"), (F.col("label") == "trivial").cast("int").alias("target"))
    r = M.fit_binary(d)
    return M.weights_table(spark, {"trivial": r} if r else {})


@query("m2_fit_cascade")
def m2(spark, sf):
    return M.weights_table(spark, M.fit_cascade(X.prompt_features(_train(spark, sf))))


@query("m3_fit_cascade_ordinal")
def m3(spark, sf):
    return M.weights_table(spark, M.fit_cascade_ordinal(X.cascade_features(_train(spark, sf), variant="retrain")))


@query("a16_top_features")
def a16(spark, sf):
    d = X.prompt_features(_train(spark, sf)).select("id", X.to_vector().alias("vec"), (F.col("label") == "trivial").cast("int").alias("target"))
    r = M.fit_binary(d)
    return M.top_features(M.weights_table(spark, {"trivial": r} if r else {})).select("tier", "rank", "feature", "weight")


_VEC = [{"code": "has_code::INT::DOUBLE", "four_plus": "(has_code::INT+has_question::INT+has_imperative::INT+(technical_terms>0)::INT)::DOUBLE"}.get(
    n, f"{n}::INT::DOUBLE" if n in ("has_question", "question_technical", "technical_design", "architecture", "has_imperative", "multi_step", "requires_context") else n)
    for n in V.FEATURE_NAMES]


@query("m4_gram", f"""WITH {Q.PROMPTS}, {P.LABEL_SQL}, {Q.f2('l1')}, v AS (SELECT {','.join(f'{e} AS x{i}' for i, e in enumerate(_VEC))}, {Q.midpoint('label')} AS y FROM f2),
  g AS (SELECT {','.join(f'sum(x{i}*x{j}) AS g_{i}_{j}' for i in range(15) for j in range(i, 15))}, {','.join(f'sum(x{i}*y) AS b_{i}' for i in range(15))} FROM v)
  SELECT unnest([{','.join([f"'g_{i}_{j}'" for i in range(15) for j in range(i, 15)] + [f"'b_{i}'" for i in range(15)])}]) AS cell,
    round(unnest([{','.join([f'g_{i}_{j}' for i in range(15) for j in range(i, 15)] + [f'b_{i}' for i in range(15)])}]),3) AS value FROM g""")
def m4_gram(spark, sf):
    d = X.sample_features(S.label_signals(A.prompts(spark, sf)))
    g = M.gram(d.select(X.optimiser_vector().alias("vec"), S.tier_value(F.col("label")).alias("y")))
    cells = [c for c in g.columns if c[0] in "gb"]
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), rnd(c, 3).alias("value")) for c in cells])).alias("e")).select("e.*")


@query("m4_fit_weights")
def m4(spark, sf):
    r = M.fit_weights(X.sample_features(_train(spark, sf)))
    return dimension(spark, ["feature", "weight", "mse_before", "mse_after"],
                     [(f, float(w), r["mse_before"], r["mse_after"]) for f, w in r["weights"].items()])


_GRID = Q.values("cand", "candidate,heuristic,cascade,retrieval,history", M.candidate_weights())


@query("m5_search_weights", f"""WITH {Q.INTERACTIONS}, {_GRID}, j AS (SELECT (latency_ms%1000)/1000.0::DOUBLE AS h, (tokens_in%97)/97.0::DOUBLE AS r, (interaction_id%9-4)/50.0::DOUBLE AS b, actual_idx FROM interactions WHERE actual_idx IS NOT NULL),
  s AS (SELECT candidate, actual_idx, {Q.clamp('h*heuristic+r*retrieval+b')} AS f FROM j, cand),
  t AS (SELECT candidate, sum((least((f>=0.1557)::INT+(f>=0.1842)::INT+(f>=0.2788)::INT+(f>=0.3488)::INT+(f>=0.4611)::INT+1,5)=actual_idx)::INT)::BIGINT AS correct FROM s GROUP BY 1)
  SELECT candidate, correct, round(heuristic,6) AS heuristic, round(retrieval,6) AS retrieval FROM t JOIN cand USING (candidate) ORDER BY correct DESC, candidate LIMIT 10""")
def m5(spark, sf):
    i = F.col("interaction_id")
    d = A.interactions(spark, sf).select((F.col("latency_ms") % 1000 / 1000.0).alias("heuristic"), (F.col("tokens_in") % 97 / 97.0).alias("retrieval"),
                                         ((i % 9 - 4) / 50.0).alias("bias"), "actual_idx")
    return M.best_weights(M.search_weights(d), 10).select("candidate", "correct", rnd("heuristic").alias("heuristic"), rnd("retrieval").alias("retrieval"))


@query("m6_training_run")
def m6(spark, sf):
    return M.training_run(_train(spark, sf))["comparison"]


# --- streams -----------------------------------------------------------------------------------
@query("z1_score_stream", f"""WITH prompts AS (SELECT doc_id AS id, text FROM documents), {Q.f1()}, {Q.cascade()}, {P._ROUTES} SELECT c.id, c.tier, c.score, r.model FROM casc c JOIN routes r USING (tier)""")
def z1(spark, sf):
    d = Z.table_stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return Z.run_to_table(Z.score_stream(d).select("id", "tier", "score", "model"))


def _log_stream(spark, sf):
    d = A.interactions_from(Z.table_stream(spark, sf, "events"))
    return (d.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("predicted_tier", S.tier_at(F.col("predicted_idx")))
            .withColumn("actual_tier", S.tier_at(F.col("actual_idx"))))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM interactions)"


@query("z2_windowed_metrics", f"""WITH {Q.INTERACTIONS}, {PF.COSTS}, w AS (SELECT date_trunc('hour', ts) AS start, predicted_tier, count(*) AS requests, count(actual_tier) AS judged,
    coalesce(sum((predicted_tier=actual_tier)::INT),0)::BIGINT AS correct, round(sum(cost_usd),8) AS cost_usd FROM costs GROUP BY 1,2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {_CLOSED}""")
def z2(spark, sf):
    d = Z.run_to_table(Z.windowed_metrics(R.request_cost(_log_stream(spark, sf), R.pricing(spark))))
    return d.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("cost_usd", rnd("cost_usd", 8))


@query("z3_sessions", f"""WITH {PF.TALK}, s AS (SELECT agent_id, min(ts) AS start, count(*) AS turns, arg_max(predicted_tier,(ts,interaction_id)) AS last_tier, arg_max(routed_model,(ts,interaction_id)) AS last_model, max(ts) AS last
    FROM turns GROUP BY agent_id, session_no) SELECT agent_id, start, turns, last_tier, last_model FROM s WHERE last + INTERVAL 1 HOUR <= {_CLOSED}""")
def z3(spark, sf):
    return Z.run_to_table(Z.sessions(_log_stream(spark, sf))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("z3_last_decisions")
def z3_decisions(spark, sf):
    i = F.col("interaction_id")
    d = _log_stream(spark, sf).select("agent_id", "ts", F.when(i % 3 == 0, F.array(F.concat(F.lit("keep "), "routed_model")))
                                      .otherwise(F.array().cast("array<string>")).alias("decisions"))
    return Z.run_to_table(Z.last_decisions(d)).select("agent_id", F.col("start").cast("timestamp_ntz").alias("start"),
                                                      F.array_join("decisions", ",").alias("decisions"))


@query("z4_match_votes_stream", PF.ORACLE["j4_match_votes"])
def z4(spark, sf):
    """Votes arrive in five parts, up to nine minutes out of order; the stream goes on from its checkpoint for each."""
    base = scratch_dir(spark)
    events = staged(Z.vote_events(A.vote_replies(spark, sf), A.vote_requests(spark, sf)).withColumn(
        "arrived", F.unix_timestamp(F.col("t").cast("timestamp")) + F.col("id") % 540))
    first, last = events.agg(F.min("arrived"), F.max("arrived")).first()
    votes = Z.VoteMatcher(f"{base}/state", f"{base}/out")
    part = F.least(F.lit(4), F.floor((F.col("arrived") - (first or 0)) * 5 / max(1, (last or 0) - (first or 0))))
    for i in range(5):
        events.where(part == i).drop("arrived").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(Z.VOTE_EVENT).parquet(f"{base}/in")
        votes.sink(stream).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    votes.finish(spark)
    return votes.matched(spark)


@query("z5_index_stream", f"WITH {PF.retrieve_sql(3)} SELECT * FROM got")
def z5(spark, sf):
    """Index entries and queries both arrive as streams; the result equals the batch lookup."""
    base = scratch_dir(spark)
    conv = Z.table_stream(spark, sf, "conversations")
    e = conv.where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("entry_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("created"),
        T.keywords(F.col("text")).alias("keywords"), T.topic_tags(F.col("text")).alias("tags"))
    once = lambda w, name: w.option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start().awaitTermination()
    once(Z.index_sink(e, f"{base}/index"), "c1")
    q = conv.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), T.keywords(F.col("text"), False).alias("keywords"))
    once(Z.retrieve_sink(q, f"{base}/index", f"{base}/out"), "c2")
    return spark.read.schema("query_id long, rank long, score long, entry_id long").parquet(f"{base}/out")


@query("z6_rolling_bias", PF.ORACLE["w3_history_bias"])
def z6(spark, sf):
    d = _log_stream(spark, sf).select("interaction_id", "agent_id", "ts", "predicted_idx", "actual_idx", "adequacy")
    return Z.run_to_table(Z.rolling_bias(d)).withColumn("bias", rnd("bias"))


@query("z7_drop_replays", f"WITH {Q.INTERACTIONS} SELECT interaction_id FROM interactions")
def z7(spark, sf):
    """Every third row arrives twice."""
    d = _log_stream(spark, sf).select("interaction_id", "ts")
    twice = d.withColumn("__n", F.explode(F.when(F.col("interaction_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__n")
    return Z.run_to_table(Z.drop_replays(twice).select("interaction_id"))

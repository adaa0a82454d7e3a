"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import text as T
from tierflow.functions.num import rnd
from tierflow.operators import convo as C, feedback as B, retrieval as I
from tierflow.plans import feedback as PF, prompts as P, sql as Q
from tierflow.sources import adapters as A

QUERIES, ORACLE = {}, {}
MODEL = "glm-4.7"
THRESHOLD, MAX_INPUT, KV = 9180, 183616, 160000


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def calls_len(c="calls"):
    return f"coalesce(length(array_to_string({c},''))+10*len({c})+1,0)"


def tok(text="text", c="calls"):
    return f"(CAST(ceil((length({text})+{calls_len(c)})/4.0::DOUBLE) AS BIGINT)+10)"


def cap_sql(src="messages", name="capped"):
    return f"""{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM {src}),
{name}_2 AS (SELECT *, max(CASE WHEN role<>'tool' THEN i END) OVER (PARTITION BY session_id ORDER BY pos) AS head FROM {name}_1),
{name}_3 AS (SELECT *, coalesce(bool_or(i=head AND role='assistant' AND calls IS NOT NULL) OVER (PARTITION BY session_id, head),false) AS chain,
   max(i) OVER (PARTITION BY session_id, head) AS chain_end FROM {name}_2),
{name} AS (SELECT session_id, pos, role, text, calls, tool_call_id FROM {name}_3 WHERE NOT (n > 60 AND
   ((role='assistant' AND calls IS NULL AND i <= n-30) OR (chain AND chain_end <= n-30))))"""


def merge_sql(src, name="merged", calls="flatten(list(calls ORDER BY pos) FILTER (calls IS NOT NULL))"):
    return f"""{name}_1 AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY session_id ORDER BY pos) <> role, true)::INT AS fresh FROM {src}),
{name}_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM {name}_1),
{name} AS (SELECT session_id, min(pos) AS pos, role, string_agg(text, chr(10)||'---'||chr(10) ORDER BY pos) AS text, {calls} AS calls,
   arg_min(tool_call_id, pos) FILTER (tool_call_id IS NOT NULL) AS tool_call_id, count(*) AS merged FROM {name}_2 GROUP BY session_id, role, run)"""


def _w(words):
    return Q.rx("text", rf"(?i)\b{Q.alt(words)}\b")


def importance_sql(src="merged", name="imp", recency="1.0-idx/n::DOUBLE"):
    tool = "(tool_call_id IS NOT NULL OR role='tool')"
    return f"""{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos)-1 AS idx, count(*) OVER (PARTITION BY session_id) AS n,
   {Q.tags('text')} AS tags, {_w(V.DECISION_WORDS)} AS dec, {_w(V.ERROR_WORDS)} AS err FROM {src}),
{name} AS (SELECT *, least(1.0::DOUBLE, ({recency})*0.25::DOUBLE + CASE WHEN {tool} THEN 0.15::DOUBLE ELSE 0.03::DOUBLE END
   + CASE WHEN role='assistant' AND calls IS NOT NULL THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN dec THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN err THEN 0.10::DOUBLE ELSE 0 END
   + CASE role WHEN 'system' THEN 0.15::DOUBLE ELSE 0 END + CASE role WHEN 'user' THEN 0.10::DOUBLE ELSE 0 END + least(1.0::DOUBLE,len(tags)/4.0::DOUBLE)*0.25::DOUBLE) AS radius,
   CASE WHEN role IN ('system','user') THEN role WHEN {tool} THEN 'tool' WHEN dec OR err THEN 'decision' ELSE 'assistant' END AS angle,
   (role='assistant' AND calls IS NOT NULL) OR (role='tool' AND (tool_call_id IS NOT NULL OR
     coalesce(lag(role='assistant' AND calls IS NOT NULL) OVER (PARTITION BY session_id ORDER BY pos),false))) AS protected FROM {name}_1)"""


def level_sql(ratio):
    lad = lambda a, b, c: f"CASE WHEN radius>{a} THEN 'Q8' WHEN radius>{b} THEN 'Q4' WHEN radius>{c} THEN 'Q2' ELSE 'Q1' END"
    return f"""CASE WHEN angle='system' OR idx>=n-3 OR angle='tool' OR protected THEN 'Q8' WHEN angle='user' THEN CASE WHEN radius>0.5 THEN 'Q8' ELSE 'Q4' END
  WHEN {ratio}>0.7 THEN {lad(.5, .3, .15)} WHEN {ratio}>0.4 THEN {lad(.6, .4, .2)} WHEN {ratio}>0.2 THEN {lad(.7, .5, .3)}
  WHEN radius>0.8 THEN 'Q4' WHEN radius>0.5 THEN 'Q2' ELSE 'Q1' END"""


def sent(t="text"):
    return f"list_filter(regexp_split_to_array({t},'[.!?]+'), lambda x: x <> '')"


FACT = rf"(?i)\b{Q.alt(V.KEY_FACT_WORDS)}\b[^.!?]*[.!?]?"


def apply_sql(src, name="ap"):
    fixed = "(role='tool' OR (role='assistant' AND calls IS NOT NULL))"
    return f"""{name}_1 AS (SELECT *, coalesce({Q.strip(f"array_to_string(list_slice({sent()},1,2),'. ')")},'') AS two, coalesce({Q.strip(f"{sent()}[1]")},'') AS one,
   regexp_extract_all(text,{Q.s(FACT)}) AS facts, NOT {fixed} AND level='Q2' AS q2, NOT {fixed} AND level='Q1' AND tool_call_id IS NULL AS q1 FROM {src}),
{name} AS (SELECT * EXCLUDE (text, two, one, facts, q1, q2), CASE WHEN q2 THEN nullif(two,'') WHEN q1 AND len(facts)>0 THEN array_to_string(list_slice(facts,1,2),' ')
     WHEN q1 THEN nullif(one,'') ELSE text END AS text,
   CASE WHEN q2 THEN CASE WHEN two='' THEN 'Q0' ELSE 'Q2' END WHEN q1 THEN 'Q1' END AS entry_tier,
   CASE WHEN q2 THEN coalesce(nullif(two,''),'(empty message)') WHEN q1 AND len(facts)>0 THEN array_to_string(list_slice(facts,1,2),' ')
     WHEN q1 THEN coalesce(nullif(one,''),'(no key facts)') END AS entry_summary FROM {name}_1)"""


def trim_sql(src, threshold="threshold", max_input="max_input", name="tr"):
    w = "(PARTITION BY session_id ORDER BY pos)"
    before = "(PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_1 AS (SELECT *, row_number() OVER {w}-1 AS ti, count(*) OVER (PARTITION BY session_id) AS tn, {tok()} AS tk FROM {src}),
{name}_2 AS (SELECT *, role<>'system' AND ti<tn-3 AND length(text)>80 AND len({sent()})>1 AS el, {Q.strip(f"{sent()}[1]")} AS cut FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN el THEN tk-{tok('cut')} ELSE 0 END AS save FROM {name}_2),
{name}_4 AS (SELECT *, el AND sum(tk) OVER (PARTITION BY session_id) - coalesce(sum(save) OVER {before},0) > {threshold} AS trimmed FROM {name}_3),
{name}_5 AS (SELECT * EXCLUDE (text), CASE WHEN trimmed THEN cut ELSE text END AS text, tk-CASE WHEN trimmed THEN save ELSE 0 END AS tk2 FROM {name}_4),
{name} AS (SELECT * EXCLUDE (tk, tk2, el, cut, save), role='assistant' AND ti<tn-3 AND sum(tk2) OVER (PARTITION BY session_id)
   - coalesce(sum(CASE WHEN role='assistant' AND ti<tn-3 THEN tk2 ELSE 0 END) OVER {before},0) > {max_input} AS dropped FROM {name}_5)"""


def compact_sql():
    return f"""{Q.MESSAGES}, {cap_sql()},
tot AS (SELECT session_id, sum({tok()}) AS original_tokens, count(*) AS n0 FROM capped GROUP BY 1),
busy AS (SELECT c.* FROM capped c JOIN tot USING (session_id) WHERE NOT (original_tokens <= {THRESHOLD} OR (n0<=5 AND original_tokens<=8000))),
quiet AS (SELECT c.* FROM capped c JOIN tot USING (session_id) WHERE original_tokens <= {THRESHOLD} OR (n0<=5 AND original_tokens<=8000)),
{merge_sql('busy')}, {importance_sql()},
lv AS (SELECT imp.*, {level_sql(f'({THRESHOLD}/original_tokens::DOUBLE)')} AS level FROM imp JOIN tot USING (session_id)),
{apply_sql('lv')}, live AS (SELECT * FROM ap WHERE text IS NOT NULL), {trim_sql('live', THRESHOLD, MAX_INPUT)},
fin AS (SELECT session_id, pos, role, text, calls, level, trimmed, dropped FROM tr
  UNION ALL SELECT session_id, pos, role, text, calls, 'Q8', false, false FROM quiet
  UNION ALL SELECT session_id, pos, role, text, calls, level, false, true FROM ap WHERE text IS NULL)"""


@query("c1_budget", f"""WITH {Q.PROMPTS}, m AS (SELECT ({Q.lst(P._MODELS)})[CAST(id % 5 AS INT)+1] AS model FROM prompts),
  w AS (SELECT *, CAST({P._win('model', V.CONTEXT_WINDOWS, V.DEFAULT_WINDOW)} AS BIGINT) AS w FROM m),
  r AS (SELECT *, greatest(4096, least(16384, CAST(floor(w*0.1::DOUBLE) AS BIGINT))) AS reserved FROM w)
  SELECT model, w AS context_window, reserved, w-reserved AS max_input, least(32000,50000,greatest(4000,CAST(floor((w-reserved)*0.05::DOUBLE) AS BIGINT))) AS threshold, count(*) AS n FROM r GROUP BY ALL""")
def c1(spark, sf):
    d = A.prompts(spark, sf).select(F.element_at(F.array(*[F.lit(m) for m in P._MODELS]), (F.col("id") % 5 + 1).cast("int")).alias("model"))
    return C.budget(d).groupBy("model", "context_window", "reserved", "max_input", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query("c2_cap_messages", f"WITH {Q.MESSAGES}, {cap_sql()} SELECT session_id, pos, role FROM capped")
def c2(spark, sf):
    return C.cap_messages(A.messages(spark, sf)).select("session_id", "pos", "role")


@query("w4_merge_runs", f"""WITH {Q.MESSAGES}, {merge_sql('messages')} SELECT session_id, pos, role, md5(text) AS text_md5,
  coalesce(array_to_string(calls,','),'') AS calls, tool_call_id, merged FROM merged""")
def w4(spark, sf):
    d = C.merge_runs(A.messages(spark, sf))
    return d.select("session_id", "pos", "role", F.md5("text").alias("text_md5"),
                    F.coalesce(F.array_join(F.col("tool_calls.id"), ","), F.lit("")).alias("calls"), "tool_call_id", "merged")


@query("c4_message_importance", f"""WITH {Q.MESSAGES}, {importance_sql('messages')}, {importance_sql('messages', 'nw', 'idx/n::DOUBLE')}
  SELECT i.session_id, i.pos, round(i.radius,6) AS radius, i.angle, round(w.radius,6) AS radius_newest FROM imp i JOIN nw w ON w.session_id=i.session_id AND w.pos=i.pos""")
def c4(spark, sf):
    d = C.message_importance(A.messages(spark, sf))
    w = C.message_importance(A.messages(spark, sf), "newest").select("session_id", "pos", rnd("radius").alias("radius_newest"))
    return d.select("session_id", "pos", rnd("radius").alias("radius"), "angle").join(w, ["session_id", "pos"])


_RATIOS = [0.9, 0.5, 0.3, 0.1]


@query("c5_assign_level", f"""WITH {Q.MESSAGES}, {merge_sql('messages')}, {importance_sql()}, r AS (SELECT imp.*, unnest([0.9::DOUBLE,0.5::DOUBLE,0.3::DOUBLE,0.1::DOUBLE]) AS ratio FROM imp)
  SELECT session_id, pos, ratio, {level_sql('ratio')} AS level FROM r""")
def c5(spark, sf):
    d = C.protect_chains(C.message_importance(C.merge_runs(A.messages(spark, sf))))
    d = d.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in _RATIOS])))
    return d.select("session_id", "pos", "ratio", C.assign_level(F.col("ratio")).alias("level"))


@query("c6_protect_chains", f"WITH {Q.MESSAGES}, {merge_sql('messages')}, {importance_sql()} SELECT session_id, pos, role, protected FROM imp")
def c6(spark, sf):
    return C.protect_chains(C.merge_runs(A.messages(spark, sf))).select("session_id", "pos", "role", "protected")


@query("c7_apply_level", f"""WITH {Q.MESSAGES}, l AS (SELECT *, (['Q8','Q4','Q2','Q1'])[CAST(pos%4 AS INT)+1] AS level FROM messages), {apply_sql('l')}
  SELECT session_id, pos, level, text, entry_tier, entry_summary FROM ap""")
def c7(spark, sf):
    d = A.messages(spark, sf).withColumn("level", F.element_at(F.array(*[F.lit(q) for q in ["Q8", "Q4", "Q2", "Q1"]]), (F.col("pos") % 4 + 1).cast("int")))
    return C.apply_level(d).select("session_id", "pos", "level", "text", "entry_tier", "entry_summary")


@query("c8_trim_to_budget", f"""WITH {Q.MESSAGES}, b AS (SELECT *, 20000 AS threshold, 15000 AS max_input FROM messages), {trim_sql('b')}
  SELECT session_id, pos, role, length(text)::BIGINT AS chars, trimmed, dropped FROM tr""")
def c8(spark, sf):
    d = A.messages(spark, sf).withColumn("threshold", F.lit(20000)).withColumn("max_input", F.lit(15000))
    return C.trim_to_budget(d).select("session_id", "pos", "role", F.length("text").cast("long").alias("chars"), "trimmed", "dropped")


@query("c9_compact", f"""WITH {compact_sql()}, s AS (SELECT session_id, sum((NOT dropped)::INT)::BIGINT AS messages, sum(CASE WHEN dropped THEN 0 ELSE {tok()} END)::BIGINT AS ct,
    {','.join(f"sum((level='{q}')::INT)::BIGINT AS {q.lower()}" for q in ['Q8', 'Q4', 'Q2', 'Q1'])}, sum((dropped AND text IS NOT NULL)::INT)::BIGINT AS q0, sum(trimmed::INT)::BIGINT AS trimmed FROM fin GROUP BY 1),
  e AS (SELECT session_id, count(*) AS entries_stored FROM ap WHERE entry_tier IS NOT NULL GROUP BY 1)
  SELECT s.* EXCLUDE (ct), ct AS compressed_tokens, original_tokens::BIGINT AS original_tokens, round(original_tokens/greatest(1,ct)::DOUBLE,6) AS ratio,
    CAST(floor(ct/1000.0::DOUBLE*{KV}+0.5) AS BIGINT) AS kv_bytes, coalesce(entries_stored,0)::BIGINT AS entries_stored FROM s JOIN tot USING (session_id) LEFT JOIN e USING (session_id)""")
def c9(spark, sf):
    m, e = C.compact(A.messages(spark, sf), MODEL)
    return C.compaction_summary(m, e).withColumn("ratio", rnd("ratio"))


@query("c9_compact_messages", f"WITH {compact_sql()} SELECT session_id, pos, role, level, md5(text) AS text_md5, trimmed FROM fin WHERE NOT dropped")
def c9_messages(spark, sf):
    m, _ = C.compact(A.messages(spark, sf), MODEL)
    return m.where(~F.col("dropped")).select("session_id", "pos", "role", "level", F.md5("text").alias("text_md5"), "trimmed")


@query("c10_compaction_entries", f"""WITH {compact_sql()}, {Q.INDEX}, ix AS (SELECT 'interaction' AS store, entry_id AS pos, tier, summary, array_to_string(keywords,' ') AS keywords FROM idx)
  SELECT 'compaction' AS store, pos, entry_tier AS tier, entry_summary AS summary, array_to_string(tags,' ') AS keywords FROM ap WHERE entry_tier IS NOT NULL UNION ALL SELECT * FROM ix""")
def c10(spark, sf):
    """Both kinds of entries in one store."""
    _, e = C.compact(A.messages(spark, sf), MODEL)
    a = e.select(F.lit("compaction").alias("store"), "pos", "tier", "summary", F.array_join("keywords", " ").alias("keywords"))
    i = A.index_entries(spark, sf).select(F.lit("interaction").alias("store"), F.col("entry_id").alias("pos"), "tier", "summary",
                                          F.array_join("keywords", " ").alias("keywords"))
    return a.unionByName(i)


@query("c11_interaction_entries", f"""WITH {Q.RESPONSES} SELECT id, array_to_string({Q.kw('prompt')},' ') AS keywords, predicted_tier AS tier, substr(response,1,200) AS summary,
  tokens_out::BIGINT AS original_tokens, CAST(floor(tokens_out/2) AS BIGINT) AS compressed_tokens FROM responses""")
def c11(spark, sf):
    d = P._responses(spark, sf).withColumn("model_used", F.lit("zai/glm-4.7")).withColumn("tokens_in", F.col("tokens_out")) \
        .withColumn("compressed_tokens", F.floor(F.col("tokens_out") / 2).cast("long"))
    return C.interaction_entries(d).select("id", F.array_join("keywords", " ").alias("keywords"), "tier", "summary", "original_tokens", "compressed_tokens")


def _broken(spark, sf):
    """Messages with blank rows, orphaned tool rows and sessions that start in the middle."""
    d = A.messages(spark, sf)
    p = F.col("pos")
    return (d.withColumn("text", F.when(p % 11 == 3, " \n ").otherwise(F.col("text")))
            .withColumn("role", F.when((p % 13 == 5) & (F.col("role") == "user"), "tool")
                        .when(F.col("session_id") % 4 == 3, F.when(F.col("role") == "user", "assistant").otherwise(F.col("role")))
                        .otherwise(F.col("role")))
            .withColumn("tool_call_id", F.when(p % 17 == 2, "tc_missing").otherwise(F.col("tool_call_id"))))


BROKEN = f"""{Q.MESSAGES}, broken AS (SELECT session_id, pos, CASE WHEN pos%13=5 AND role='user' THEN 'tool' WHEN session_id%4=3 AND role='user' THEN 'assistant' ELSE role END AS role,
  CASE WHEN pos%11=3 THEN ' '||chr(10)||' ' ELSE text END AS text, calls, CASE WHEN pos%17=2 THEN 'tc_missing' ELSE tool_call_id END AS tool_call_id FROM messages)"""

SANE = f"""{BROKEN}, nt AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM broken), single AS (SELECT * FROM nt WHERE n=1),
nonsys AS (SELECT * EXCLUDE (n) FROM nt WHERE n>1 AND role<>'system'), {merge_sql('nonsys', 'mg', '(list(calls ORDER BY pos))[1]')},
fu AS (SELECT session_id, min(pos) AS u FROM mg WHERE role='user' GROUP BY 1),
body AS (SELECT mg.session_id, 1 AS part, pos, role, text, CASE WHEN calls IS NOT NULL AND len(calls)>0 THEN calls END AS calls, tool_call_id FROM mg LEFT JOIN fu USING (session_id) WHERE u IS NULL OR pos>=u),
al AS (SELECT session_id, 0 AS part, pos, role, text, calls, tool_call_id FROM nt WHERE n>1 AND role='system' UNION ALL SELECT * FROM body),
ids AS (SELECT DISTINCT session_id, unnest(calls) AS cid FROM al WHERE role='assistant' AND calls IS NOT NULL),
ok AS (SELECT al.*, lag(role) OVER (PARTITION BY al.session_id ORDER BY part, pos) AS prev FROM al LEFT JOIN ids ON ids.session_id=al.session_id AND ids.cid=al.tool_call_id
  WHERE NOT ({Q.strip('text')}='' AND NOT (role='assistant' AND calls IS NOT NULL)) AND NOT (role='tool' AND tool_call_id IS NOT NULL AND cid IS NULL)),
tl AS (SELECT * FROM ok WHERE role<>'tool' OR prev='assistant'),
ld AS (SELECT * FROM tl QUALIFY sum((role IN ('system','user'))::INT) OVER (PARTITION BY session_id ORDER BY part, pos) > 0),
fil AS (SELECT DISTINCT session_id FROM nt WHERE n>1 AND session_id NOT IN (SELECT session_id FROM ld WHERE role='user')),
res AS (SELECT session_id, part, pos, role, text FROM ld UNION ALL SELECT session_id, 1, pos, role, text FROM single
  UNION ALL SELECT session_id, 1, -1, 'user', {Q.s(V.CONTINUE_TEXT)} FROM fil)"""


@query("c12_sanitise", f"""WITH {SANE} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, pos)-1 AS pos, role, md5(text) AS text_md5 FROM res""")
def c12(spark, sf):
    return C.sanitise(_broken(spark, sf)).select("session_id", "pos", "role", F.md5("text").alias("text_md5"))


def _notes(spark, sf):
    """Decisions of each session's last turns and, for some, a retrieved line."""
    d = A.messages(spark, sf).where("role = 'assistant'").groupBy("session_id").agg(F.max_by("text", "pos").alias("t"))
    return d.select("session_id", F.when(F.col("session_id") % 3 != 0, F.concat(F.lit(T.CONTEXT_HEADER), T.context_note(F.lit("assistant"), F.substring("t", 1, 50)))).alias("context_note"),
                    T.continuity_note(F.array(F.lit("keep kafka"), F.substring("t", 1, 20)), F.lit("heavy"), F.lit("glm-5.1")).alias("continuity_note"))


@query("c13_augment", f"""WITH {Q.MESSAGES}, m2 AS (SELECT * FROM messages WHERE NOT (session_id%2=1 AND role='system')), lt AS (SELECT session_id, arg_max(text,pos) AS t FROM messages WHERE role='assistant' GROUP BY 1),
  nt AS (SELECT session_id, CASE WHEN session_id%3<>0 THEN 'Relevant prior context (auto-retrieved):'||chr(10)||'[Retrieved context from assistant: '||substr(t,1,50)||']' END AS c,
    chr(10)||chr(10)||'Continuity from previous turn (heavy→glm-5.1):'||chr(10)||'- keep kafka'||chr(10)||'- '||substr(t,1,20) AS k FROM lt),
  sp AS (SELECT session_id, min(pos) AS sp FROM m2 WHERE role='system' GROUP BY 1)
  SELECT m2.session_id, pos, role, md5(CASE WHEN pos=sp AND nt.k IS NOT NULL THEN text||coalesce(chr(10)||chr(10)||c,'')||k ELSE text END) AS text_md5 FROM m2 LEFT JOIN sp USING (session_id) LEFT JOIN nt ON nt.session_id=m2.session_id
  UNION ALL SELECT nt.session_id, -1, 'system', md5(CASE WHEN c IS NOT NULL THEN c||k ELSE {Q.strip('k')} END) FROM nt WHERE session_id NOT IN (SELECT session_id FROM sp)""")
def c13(spark, sf):
    m = A.messages(spark, sf).where("NOT (session_id % 2 = 1 AND role = 'system')")
    return C.augment(m, _notes(spark, sf)).select("session_id", "pos", "role", F.md5("text").alias("text_md5"))

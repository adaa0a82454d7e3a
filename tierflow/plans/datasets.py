"""Queries over dataset preparation, generation and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow import vocab as V
from tierflow.functions import features as X, scoring as S
from tierflow.functions.num import rnd
from tierflow.operators import dataset as D, redact as RD
from tierflow.operators.scale import staged
from tierflow.plans import prompts as P, sql as Q
from tierflow.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def _docs(spark, sf):
    return A.text_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@query("s4_load_instructions", f"""WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 600), prompts AS (SELECT doc_id AS id, {Q.strip('text')} AS text FROM f WHERE length(text) > 10),
  {P.LABEL_SQL} SELECT id, label, md5(text) AS text_md5 FROM l1""")
def s4(spark, sf):
    d = D.load_instructions(_docs(spark, sf), "text", 600)
    return d.select("id", "label", F.md5("text").alias("text_md5"))


@query("d1_dedup_exact", "SELECT min(doc_id) AS id, arg_min(lang, doc_id) AS lang, md5(text) AS text_md5 FROM documents GROUP BY text")
def d1(spark, sf):
    return D.dedup_exact(_docs(spark, sf)).select("id", "lang", F.md5("text").alias("text_md5"))


def _labelled(spark, sf):
    d = S.label_signals(_docs(spark, sf))
    return d.withColumn("word_count", F.size(X.T.word_tokens(F.lower("text"))).cast("double")).withColumnRenamed("lang", "domain")


LAB = f"""prompts AS (SELECT doc_id AS id, text FROM documents), {P.LABEL_SQL}, lab AS (SELECT l1.*, source, lang AS domain,
  len(regexp_extract_all(lower(l1.text),'{Q.WORD}+'))::DOUBLE AS word_count FROM l1 JOIN documents ON doc_id=id)"""


@query("a4_dataset_stats", f"""WITH {LAB} SELECT 'label' AS kind, label AS value, count(*) AS n, round(avg(word_count),6) AS mean_words FROM lab GROUP BY label
  UNION ALL SELECT 'source', source, count(*), round(avg(word_count),6) FROM lab GROUP BY source UNION ALL SELECT 'domain', domain, count(*), round(avg(word_count),6) FROM lab GROUP BY domain
  UNION ALL SELECT 'all', 'all', count(*), round(avg(word_count),6) FROM lab""")
def a4(spark, sf):
    return D.dataset_stats(_labelled(spark, sf)).withColumn("mean_words", rnd("mean_words"))


@query("a5_validate_dataset", f"""WITH {LAB}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), w AS (SELECT count(*) AS n, 1-count(DISTINCT text)/count(*)::DOUBLE AS r, avg(word_count) AS aw,
    sum((length(text)<5)::INT)::BIGINT AS sh, sum((length(text)>4000)::INT)::BIGINT AS lo, min(word_count)=max(word_count) AS z, (SELECT count(*) FROM c) AS k FROM lab),
  i AS (SELECT 'Too few samples: '||n||' < 5000' AS issue FROM w WHERE n < 5000 UNION ALL SELECT 'Dataset has only one class — needs variety for optimization' FROM w WHERE k<2
    UNION ALL SELECT 'High duplicate rate: '||round(r*100,1)||'% > 10%' FROM w WHERE r>0.10 UNION ALL SELECT sh||' samples too short (<5 chars)' FROM w WHERE sh>0
    UNION ALL SELECT lo||' samples too long (>4000 chars)' FROM w WHERE lo>0 UNION ALL SELECT 'word_count has zero variance — feature is useless' FROM w WHERE z
    UNION ALL SELECT 'Class '''||label||''' underrepresented: '||round(c.n/w.n::DOUBLE*100,1)||'% < 5%' FROM c, w WHERE c.n/w.n::DOUBLE<0.05)
  SELECT n AS sample_count, round(r,3) AS duplicate_rate, round(aw,1) AS avg_word_count, false AS passed, issue FROM w, i""")
def a5(spark, sf):
    d = D.validate_dataset(_labelled(spark, sf), 5000)
    return d.select("sample_count", "duplicate_rate", "avg_word_count", "passed", F.explode("issues").alias("issue"))


def _score_sql():
    return f"{Q.PROMPTS}, {Q.f5()}, sc AS (SELECT {Q.GATEWAY_HEURISTIC} AS score FROM f5)"


@query("a12_calibrate_bounds", f"""WITH {_score_sql()} SELECT count(*) AS total, {','.join(Q.rnd(e) + ' AS ' + n for e, n in [('min(score)', 'min'), ('max(score)', 'max'), ('avg(score)', 'mean'),
  ('quantile_cont(score,0.05)', 'light_from'), ('quantile_cont(score,0.2)', 'moderate_from'), ('quantile_cont(score,0.45)', 'heavy_from'), ('quantile_cont(score,0.7)', 'intensive_from'),
  ('quantile_cont(score,0.9)', 'extreme_from'), ('quantile_cont(score,0.5)', 'median')])} FROM sc""")
def a12(spark, sf):
    d = X.gateway_features(A.prompts(spark, sf)).select(S.gateway_heuristic().alias("score"))
    d = D.calibrate_bounds(d)
    return d.select("total", *[rnd(c).alias(c) for c in d.columns if c != "total"])


def _rank_sql(src, keys, idc="id", seed=42):
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {Q.uhash(idc, seed)}, {idc}) AS rk, count(*) OVER ({part.strip()}) AS tot FROM {src}"


@query("p2_stratified_split", f"WITH {LAB}, r AS ({_rank_sql('lab', 'label')}) SELECT id, label, CASE WHEN rk <= floor(tot*0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r")
def p2(spark, sf):
    # the split reads its input three times; labels are computed once
    return D.stratified_split(staged(_labelled(spark, sf).select("id", "label")))


@query("p2_random_split", f"WITH d AS (SELECT doc_id AS id FROM documents), r AS ({_rank_sql('d', '')}) SELECT id, CASE WHEN rk <= floor(tot*0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r")
def p2_random(spark, sf):
    return D.random_split(_docs(spark, sf).select("id"))


@query("p3_balanced_sample", f"""WITH {LAB}, b AS (SELECT id, (label='heavy')::INT AS target FROM lab), r AS ({_rank_sql('b', 'target')}), m AS (SELECT min(tot) AS m FROM r)
  SELECT id, target FROM r, m WHERE m>=10 AND rk<=m""")
def p3(spark, sf):
    d = _labelled(spark, sf).select("id", (F.col("label") == "heavy").cast("int").alias("target"))
    return D.balanced_sample(staged(d))


# --- generation -----------------------------------------------------------------------------
def _ids(spark, sf):
    return A.text_table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                                  F.when(F.col("doc_id") % 10 < 7, "trivial").otherwise("light").alias("label"))


def pick_sql(values, key, salt):
    return f"({Q.lst(values)})[({Q.uhash(key, salt)} % {len(values)} + 1)::INT]"


def filled_sql(templates, pools, rest, key="id", seed=42):
    e = pick_sql(templates, key, f"{seed}template")
    for slot, values in pools.items():
        e = f"replace({e},'{{{slot}}}',{pick_sql(values, key, f'{seed}{slot}')})"
    return f"regexp_replace({e},'\\{{[^}}]+\\}}','{rest}','g')"


GEN = f"""ids AS (SELECT doc_id AS id, CASE WHEN doc_id%10<7 THEN 'trivial' ELSE 'light' END AS label FROM documents),
gen0 AS (SELECT id, label, CASE WHEN label='trivial' THEN {filled_sql(V.TRIVIAL_TEMPLATES, V.TRIVIAL_POOLS, 'something')} ELSE {filled_sql(V.LIGHT_TEMPLATES, V.LIGHT_POOLS, 'data')} END AS text FROM ids),
gen AS (SELECT *, 'gpd_syn_'||substr(md5('synthetic:'||id||':'||substr(text,1,100)),1,12) AS sample_id, 'gpd-synthetic' AS source, 'general' AS domain,
  CASE WHEN label='trivial' THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN label='trivial' OR {Q.uhash('id', '42intent')}/4294967296.0::DOUBLE < 0.5 THEN 'query' ELSE 'command' END AS intent FROM gen0)"""


@query("g1_generate_prompts", f"WITH {GEN} SELECT * FROM gen")
def g1(spark, sf):
    return D.generate_prompts(_ids(spark, sf))


def graded_sql():
    base = " ".join(f"WHEN '{t}' THEN {pick_sql(V.GRADED_PROMPTS[t], 'doc_id', '42base')}" for t in V.TIERS)
    return f"""gr0 AS (SELECT doc_id AS id, {Q.tier_at('doc_id%6')} AS tier FROM documents), gr1 AS (SELECT id, tier, CASE tier {base.replace('doc_id', 'id')} END AS b FROM gr0),
gr2 AS (SELECT id, tier, CASE WHEN {Q.uhash('id', '42suffix')}/4294967296.0::DOUBLE < 0.3 THEN b||{Q.s(V.GRADED_SUFFIX)} ELSE b END AS t FROM gr1),
graded AS (SELECT id, tier, CASE WHEN {Q.uhash('id', '42prefix')}/4294967296.0::DOUBLE < 0.2 THEN {Q.s(V.GRADED_PREFIX)}||lower(t) ELSE t END AS text FROM gr2)"""


@query("g2_generate_graded", f"WITH {graded_sql()} SELECT * FROM graded")
def g2(spark, sf):
    return D.generate_graded(_ids(spark, sf).select("id"))


@query("g3_generate_dataset", f"""WITH {GEN}, {Q.f4('gen')}, r AS ({_rank_sql('f4', '')}), p AS (SELECT *, CASE WHEN rk<=floor(tot*0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r)
  SELECT 'part' AS kind, part AS value, count(*) AS n, NULL::DOUBLE AS mean_words FROM p GROUP BY part UNION ALL SELECT 'label', label, count(*), round(avg(word_count),6) FROM p GROUP BY label
  UNION ALL SELECT 'source', source, count(*), round(avg(word_count),6) FROM p GROUP BY source UNION ALL SELECT 'domain', domain, count(*), round(avg(word_count),6) FROM p GROUP BY domain
  UNION ALL SELECT 'all', 'all', count(*), round(avg(word_count),6) FROM p""")
def g3(spark, sf):
    d, stats = D.generate_dataset(_ids(spark, sf))
    parts = d.groupBy(F.lit("part").alias("kind"), F.col("part").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("mean_words", F.lit(None).cast("double"))
    return parts.unionByName(stats.withColumn("mean_words", rnd("mean_words")))


# --- redaction ----------------------------------------------------------------------------
# rules whose boundaries plain SQL can restate with consumed neighbours
ASCII_RULES = [r for r in RD.RULES if RD.EDGE not in r[2] and not r[2].endswith(f"(?={Q.WORD})")]


def redact_sql():
    nw = r"[^\p{L}\p{N}_]"
    ctes = ["red_0 AS (SELECT id, text AS t FROM prompts)"]
    for i, (cat, _, pattern, repl) in enumerate(ASCII_RULES, 1):
        p, flags = pattern, ""
        for f in ("(?iu)", "(?i)", "(?s)"):
            if p.startswith(f):
                flags, p = f.replace("u", ""), p[len(f):]
        lead = p.startswith(RD.START)
        p = p[len(RD.START):] if lead else p
        trail = p.endswith(RD.END)
        p = p[:-len(RD.END)] if trail else p
        keep = ",".join(["id"] + [f"c{j}" for j in range(1, i)])
        if not lead and not trail:
            rep = repl.replace("$1", "\\1")
            ctes.append(f"red_{i} AS (SELECT {keep}, {Q.rx_n('t', flags + p)} AS c{i}, regexp_replace(t,{Q.s(flags + p)},{Q.s(rep)},'g') AS t FROM red_{i-1})")
            continue
        full = flags + (f"(^|{nw})" if lead else "()") + f"(?:{p})" + (f"({nw}|$)" if trail else "()")
        if repl is None:  # lengths 5 and 6; longer digit runs fall to the hash rule or are matched whole
            one = lambda t, k: f"regexp_replace({t},{Q.s(f'(^|{nw})[0-9]{{{k}}}({nw}|$)')},'\\1[NUMBER_{k}]\\2','g')"
            e = "t"
            for k in (5, 6):
                e = one(one(e, k), k)
            ctes.append(f"red_{i}a AS (SELECT {keep}, t AS o, {e} AS t FROM red_{i-1})")
            ctes.append(f"red_{i} AS (SELECT {keep}, CAST((length(t)-length(replace(t,'[NUMBER_','')))/8 - (length(o)-length(replace(o,'[NUMBER_','')))/8 AS BIGINT) AS c{i}, t FROM red_{i}a)")
            continue
        rep = "\\1" + repl.replace("\\", "") + "\\2"
        ctes.append(f"red_{i}a AS (SELECT {keep}, {Q.rx_n('t', full)} AS x, regexp_replace(t,{Q.s(full)},{Q.s(rep)},'g') AS t FROM red_{i-1})")
        ctes.append(f"red_{i} AS (SELECT {keep}, x + {Q.rx_n('t', full)} AS c{i}, regexp_replace(t,{Q.s(full)},{Q.s(rep)},'g') AS t FROM red_{i}a)")
    last = len(ASCII_RULES)
    sums = ",".join("CAST(" + "+".join(f"c{i}" for i, r in enumerate(ASCII_RULES, 1) if r[0] == cat) + f" AS BIGINT) AS n_{cat}" for cat in RD.CATEGORIES)
    return f"{Q.PROMPTS}, " + ", ".join(ctes) + f", red AS (SELECT id, t AS text, {sums} FROM red_{last})"


@query("p1_redact_rules", f"WITH {redact_sql()} SELECT id, md5(text) AS text_md5, n_pii, n_secret, n_context, n_generalized FROM red")
def p1_rules(spark, sf):
    """The rules that plain SQL can state."""
    d = RD.redact(A.prompts(spark, sf), rules=ASCII_RULES)
    return d.select("id", F.md5("text").alias("text_md5"), *[f"n_{c}" for c in RD.CATEGORIES])


@query("p1_redact")
def p1(spark, sf):
    """All 35 rules, rules that need look-around included."""
    d = RD.redact(A.prompts(spark, sf))
    return d.select("id", F.md5("text").alias("text_md5"), *[f"n_{c}" for c in RD.CATEGORIES])


@query("a15_redaction_report", f"WITH {redact_sql()} SELECT count(*) AS samples, {','.join(f'sum(n_{c})::BIGINT AS {c}' for c in RD.CATEGORIES)}, sum({'+'.join('n_' + c for c in RD.CATEGORIES)})::BIGINT AS total FROM red")
def a15(spark, sf):
    return RD.redaction_report(RD.redact(A.prompts(spark, sf), rules=ASCII_RULES))


@query("p7_redact_dataset")
def p7(spark, sf):
    """Text and context values; the context holds the head of the text and a short value."""
    d = A.prompts(spark, sf).withColumn("context", F.create_map(
        F.lit("note"), F.concat(F.lit("mail ops@example.com about "), F.substring("text", 1, 40)), F.lit("k"), F.lit("short")))
    d = RD.redact_dataset(d, max_n=None, at="2024-01-01 00:00:00")
    return d.select("id", F.md5("text").alias("text_md5"), F.col("context")["note"].alias("note"),
                    F.col("context")["k"].alias("k"), "anonymized", *[f"n_{c}" for c in RD.CATEGORIES])


def _merged(spark, sf, cap):
    p = A.prompts(spark, sf)
    big = 1000000000000
    a = p.where(F.col("id") < big).withColumn("source", F.lit("documents"))
    b = p.where(F.col("id") >= big).select("text", "id", F.lit("turns").alias("source"))
    d = D.merge_datasets([a, b], cap, redacted=False)
    return RD.redact(d, rules=ASCII_RULES).select("id", "source", F.md5("text").alias("text_md5"))


_SOURCED = "src AS (SELECT id, CASE WHEN id < 1000000000000 THEN 'documents' ELSE 'turns' END AS source FROM prompts)"


@query("u1_merge_datasets", f"""WITH {redact_sql()}, {_SOURCED} SELECT src.id, source, md5(text) AS text_md5 FROM src JOIN red USING (id)""")
def u1(spark, sf):
    return _merged(spark, sf, None)


@query("u1_merge_datasets_capped", f"""WITH {redact_sql()}, {_SOURCED}, r AS ({_rank_sql('src', '')})
  SELECT r.id, source, md5(text) AS text_md5 FROM r JOIN red USING (id) WHERE rk <= 700""")
def u1_capped(spark, sf):
    return _merged(spark, sf, 700)


@query("u2_training_union", f"""WITH {GEN}, prompts AS (SELECT doc_id AS id, text FROM documents), {P.LABEL_SQL} SELECT 'gpd-synthetic' AS source, label, count(*) AS n FROM gen GROUP BY 2
  UNION ALL SELECT 'instructions', label, count(*) FROM l1 GROUP BY 2""")
def u2(spark, sf):
    ins = S.label_signals(_docs(spark, sf).select("id", "text")).withColumn("source", F.lit("instructions"))
    return D.training_union(D.generate_prompts(_ids(spark, sf)), ins).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))

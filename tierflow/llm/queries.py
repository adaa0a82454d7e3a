"""Registered queries of this package: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow.llm.decontamination import contamination
from tierflow.llm.fingerprints import edited, fingerprints, likeness, order_minhash, with_next
from tierflow.llm.hard_negatives import hard_negatives
from tierflow.llm.line_dedup import line_dedup
from tierflow.llm.packing import pack
from tierflow.llm.quality import score as quality_score
from tierflow.llm.simhash import near_duplicates
from tierflow.llm.spelling import spelling_variants
from tierflow.llm.substring_dedup import substring_dedup
from tierflow.llm.suffix_dedup import suffix_dedup
from tierflow.llm.token_counts import token_counts
from tierflow.llm.toxicity import score
from tierflow.llm.url_filter import judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # local workers import this package from where the driver has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark, sf_dir):
    own = with_next(fingerprints(table(spark, sf_dir, "documents")), {"text": "next_text", "fingerprint": "next_fingerprint"})
    changed = own.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fingerprint", order_minhash(F.col("edited")))
    return changed.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return _lines(spark, sf_dir)


def op4_every_line_dedup(spark, sf_dir):
    """As op4_line_dedup, and equal lines of any length go, as in the pipeline."""
    return _lines(spark, sf_dir, exact=1)


def _lines(spark, sf_dir, **how):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), lines="n_lines", removed="n_removed", **how)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op6_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sentences")


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("hits").cast("bigint").alias("n_windows"),
                        F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"))


def op10_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_quality(spark, sf_dir):
    return quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rules")


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", other), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_token_counts, op3_simhash_near_dedup, op4_line_dedup, op5_suffix_dedup, op6_toxicity,
                                  op7_substring_dedup, op8_best_fit_packing, op9_benchmark_decontamination, op10_url_filter, op11_spelling_variants, op12_quality, op13_hard_negatives,
                                  op4_every_line_dedup)}

ORACLE = {
    "op4_line_dedup": """
with l as (select doc_id, i, ls[i] as t from (select *, unnest(range(1, len(ls)+1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
f as (select t, strlen(t) as n, min(row(doc_id, i)) as p from l where strlen(t) >= 30 group by t),
m as (select b.t, min(a.p) as p from f b join (select *, unnest([n-2, n-1, n, n+1, n+2]) as near from f) a
        on b.n = a.near where a.p <= b.p and levenshtein(a.t, b.t) <= 2 group by b.t),
k as (select doc_id, i, t, coalesce(m.p < row(doc_id, i), false) as gone from l left join m using (t))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_removed,
  sha256(coalesce(string_agg(t, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by doc_id""",
    "op4_every_line_dedup": """
with l as (select doc_id, i, ls[i] as t from (select *, unnest(range(1, len(ls)+1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
f as (select t, strlen(t) as n, min(row(doc_id, i)) as p from l where t <> '' group by t),
m as (select b.t, min(a.p) as p from (select * from f where n >= 30) b join (select *, unnest([n-2, n-1, n, n+1, n+2]) as near from f where n >= 30) a
        on b.n = a.near where a.p <= b.p and levenshtein(a.t, b.t) <= 2 group by b.t),
k as (select l.doc_id, l.i, l.t, coalesce(least(f.p, m.p) < row(l.doc_id, l.i), false) as gone from l left join f using (t) left join m using (t))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_removed,
  sha256(coalesce(string_agg(t, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by doc_id""",
    "op13_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as good, cast(list_dot_product(a.v, b.v) as bigint) as score
        from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where good qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, p.id as positive_id, cast(row_number() over (partition by anchor_id, p.id order by n.score desc, n.id) as integer) as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n using (anchor_id) where not n.good and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by anchor_id, p.id order by n.score desc, n.id) <= 3""",
    "op5_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2*i+1, 100) as g from (select *, unnest(range(0, n-49)) as i from d)),
m as (select g, min(doc_id) as least from w group by g having count(*) > 1),
r as (select w.doc_id, w.i from w join m using (g) where least < w.doc_id),
s as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from r),
e as (select *, sum(new) over (partition by doc_id order by i) as k from s),
spans as (select doc_id, min(i) as a, max(i)+50 as b from e group by doc_id, k),
p as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as pb from spans),
q as (select doc_id, count(*) as n_spans, sum(b-a) as n_removed, max(b) as tail,
        string_agg(substr(h, 2*pb+1, 2*(a-pb)), '' order by a) as left_over from p join d using (doc_id) group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(left_over, '') || substr(h, 2*coalesce(tail, 0)+1))) as kept_sha256
from d left join q using (doc_id)""",
    "op7_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, array_to_string(ws[i+1:i+20], ' ') as g from (select *, unnest(range(0, len(ws)-19)) as i from d)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from w) where k > 1),
gone as (select distinct doc_id, i + j as pos from r, range(20) t(j)),
u as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as pos from d),
k as (select doc_id, string_agg(word, ' ' order by pos) as left_over, count(*) as n from u anti join gone using (doc_id, pos) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed,
  sha256(coalesce(left_over, '')) as kept_sha256
from d left join k using (doc_id)""",
}

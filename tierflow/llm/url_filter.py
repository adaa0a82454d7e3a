"""URL filter: host and path rules decide first, gradient-boosted trees on lexical features decide the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tierflow.operators.scale import staged

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest rule wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE = 20_000  # labelled URLs that a fit reads, about
TREES, DEPTH = 12, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, h + p).otherwise(which), F.when(fits, said).otherwise(verdict)
    return which, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    return F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(F.length(text), F.lit(1))),
                       F.lit(0.0), lambda s, p: s - p * F.log2(p))


FEATURES = {
    "f_length": lambda u: F.length(u), "f_host_length": lambda u: F.length("host"), "f_path_length": lambda u: F.length("path"),
    "f_depth": lambda u: F.regexp_count("path", F.lit("[^/]+")), "f_labels": lambda u: F.regexp_count("host", F.lit("[^.]+")),
    "f_digits": lambda u: F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)),
    "f_hyphens": lambda u: F.regexp_count("host", F.lit("-")), "f_entropy": lambda u: entropy(u), "f_host_entropy": lambda u: entropy(F.col("host")),
    "f_parameters": lambda u: F.regexp_count(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), F.lit("[^&;]+")),
    "f_fragment": lambda u: F.contains(u, F.lit("#")).cast("int"), "f_secure": lambda u: F.lower(F.substring(u, 1, 6)).eqNullSafe("https:").cast("int"),
    "f_dot_end": lambda u: F.regexp_count("path", F.lit(r"\.[a-z0-9]{2,5}$")),
    "f_first_length": lambda u: F.length(F.regexp_extract("path", "^/([^/]*)", 1)),
    "f_suffix_length": lambda u: F.length("suffix"),
}
COUNTS = ("f_suffix_share", "f_suffix_hosts")


def lexical(pages: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the features; suffix statistics are counted over all pages."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = (pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
            .withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)))
    rows = rows.withColumns({k: f(url).cast("double") for k, f in FEATURES.items()})
    # hosts first, so a suffix that most pages share is counted from as many rows as it has hosts
    hosts = rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))
    of = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("h"))
    total = F.lit(float(pages.count() or 1))
    stats = of.select("suffix", (F.col("n") / total).alias(COUNTS[0]), F.log2(F.col("h").cast("double")).alias(COUNTS[1]))
    return rows.join(stats, "suffix")


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability (the trees'), one row per row of ``pages``.

    URLs that a rule decides are the labelled ones; the trees are fitted to about ``sample`` of them, picked by a hash of the URL, and
    judge the URLs that no rule fits (block at 0.5 or more). ``rules`` is a short list. A null or empty URL, or one without "://", has an empty host and path, fits no
    rule and is judged by the trees; a null page_id stays null; repeated rows are judged each; where the rules label one kind only, or nothing, the
    trees' verdict is that kind, or allow; an empty table gives no rows; other columns are ignored.
    """
    rows = lexical(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")))
    which, said = rule(F.col("host"), F.col("path"), rules)
    rows = VectorAssembler(inputCols=[*FEATURES, *COUNTS], outputCol="features").transform(
        rows.select("page_id", "url", "host", "path", which.alias("rule"), said.alias("said"), *FEATURES, *COUNTS))
    labelled = rows.where("said is not null").select("url", "features", (F.col("said") == "block").cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        p = F.lit(float(next(iter(counts), 0.0)))
        judged = rows.withColumn("block_probability", p)
    else:
        share = int(min(1.0, sample / sum(counts.values())) * (1 << 20))
        picked = staged(labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share).select("features", "label"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(picked)
        judged = model.transform(rows).withColumn("block_probability", vector_to_array("probability")[1])
    method = F.when(F.col("block_probability") >= .5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "block_probability")

"""Dataset preparation: dedup, validation, splits, balanced samples, unions, generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S, text as T
from tierflow.functions.num import rnd
from tierflow.operators.scale import first_per_key, staged, uniform_hash, unit_hash


def load_instructions(df: DataFrame, col: str, max_n: int, order: str = "id") -> DataFrame:
    """First ``max_n`` rows; of these, texts longer than 10 characters, trimmed and labelled."""
    d = first_n(df, max_n, order).where(F.length(col) > 10).withColumn("text", T.strip(F.col(col)))
    return S.label_signals(d.select(order, "text"), "text")


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """First n rows by a column. The cut value is found on that column alone, so the rows
    themselves are neither sorted nor shuffled."""
    cut = df.select(order).orderBy(order).limit(n).agg(F.max(order).alias("__cut"), F.lit(1).alias("__k"))
    return (df.withColumn("__k", F.lit(1)).join(F.broadcast(cut), "__k")
            .where(F.col(order) <= F.col("__cut")).drop("__k", "__cut"))


def dedup_exact(df: DataFrame, text: str = "text", order: str = "id") -> DataFrame:
    """First row of each text. Copies are folded before the shuffle, which runs on a digest."""
    d = df.withColumn("__digest", F.sha2(F.col(text), 256))
    return first_per_key(d, ["__digest"], [order]).drop("__digest").select(*df.columns)


def dataset_stats(df: DataFrame, by=("label", "source", "domain"), words: str = "word_count") -> DataFrame:
    """Rows and mean words per label, per source, per domain and over all, in one pass."""
    part = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("w"))
    sets = [[F.col(b)] for b in by] + [[]]
    g = part.groupingSets(sets, *[F.col(b) for b in by]).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.grouping_id().alias("gid"))
    kind, value = F.lit("all"), F.lit("all")
    full = (1 << len(by)) - 1
    for i, b in enumerate(by):
        hit = F.col("gid") == full - (1 << (len(by) - 1 - i))
        kind, value = F.when(hit, b).otherwise(kind), F.when(hit, F.col(b)).otherwise(value)
    return g.select(kind.alias("kind"), value.alias("value"), "n", (F.col("w") / F.col("n")).alias("mean_words"))


def validate_dataset(df: DataFrame, min_samples: int = 100, text: str = "text", label: str = "label",
                     words: str = "word_count") -> DataFrame:
    """One row: counts, duplicate rate, mean words, issues and the verdict."""
    digest = F.sha2(F.col(text), 256)
    # copies fold first, so a text that fills a third of the rows is one row afterwards; read twice, labelled once
    part = staged(df.groupBy(F.col(label).alias("label"), digest.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length(text)).alias("len"), F.min(words).alias("lo"),
        F.max(words).alias("hi"), F.sum(words).alias("w")))
    per_text = part.groupBy("d").agg(
        F.sum("n").alias("n"), F.min("len").alias("len"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("w").alias("w"))
    whole = per_text.agg(
        F.sum("n").alias("samples"), F.count(F.lit(1)).alias("texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("w").alias("w"), F.sum(F.when(F.col("len") < 5, F.col("n")).otherwise(0)).alias("short"),
        F.sum(F.when(F.col("len") > 4000, F.col("n")).otherwise(0)).alias("long"), F.lit(1).alias("k"))
    labels = part.groupBy("label").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("classes"), F.lit(1).alias("k"))
    d = whole.join(labels, "k").drop("k")
    n = F.col("samples")
    rate = 1 - F.col("texts") / F.greatest(n, F.lit(1))
    pct = lambda x: F.concat(rnd(x * 100, 1).cast("string"), F.lit("%"))
    rare = F.transform(F.filter("classes", lambda c: c["n"] / n < 0.05), lambda c: F.concat(
        F.lit("Class '"), c["label"], F.lit("' underrepresented: "), pct(c["n"] / n), F.lit(" < 5%")))
    issues = F.array_compact(F.array(
        F.when(n < min_samples, F.concat(F.lit("Too few samples: "), n.cast("string"), F.lit(f" < {min_samples}"))),
        F.when(F.size("classes") < 2, "Dataset has only one class — needs variety for optimization"),
        F.when(rate > 0.10, F.concat(F.lit("High duplicate rate: "), pct(rate), F.lit(" > 10%"))),
        F.when(F.col("short") > 0, F.concat(F.col("short").cast("string"), F.lit(" samples too short (<5 chars)"))),
        F.when(F.col("long") > 0, F.concat(F.col("long").cast("string"), F.lit(" samples too long (>4000 chars)"))),
        F.when(F.col("lo") == F.col("hi"), "word_count has zero variance — feature is useless")))
    d = d.withColumn("issues", F.concat(issues, rare))
    return d.select(n.alias("sample_count"), "classes", rnd(rate, 3).alias("duplicate_rate"),
                    rnd(F.col("w") / F.greatest(n, F.lit(1)), 1).alias("avg_word_count"), "issues",
                    (F.size("issues") == 0).alias("passed"))


def seeded_take(df: DataFrame, keys: list[str], id_col: str, seed, quota, buckets: int = 4096) -> DataFrame:
    """Adds ``taken``: whether the row is among the first ``quota`` of its key in seeded
    hash order. Exact, without sorting or shuffling the rows.

    Hash buckets are counted per key; whole buckets below the cut are taken, and only the
    one bucket on the cut is ranked. ``quota(total, smallest)`` gets the key's size and the
    smallest key's size.
    """
    width = 4294967296 // buckets
    h = df.withColumn("__h", uniform_hash(F.col(id_col), seed)).withColumn("__b", F.floor(F.col("__h") / width))
    counts = h.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("__b")
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    per_key = c.groupBy(*keys).agg(F.max("total").alias("total"),
                                   F.collect_list(F.struct("__b", "n", "upto")).alias("l"))  # at most ``buckets`` items
    q = quota(F.col("total"), F.min("total").over(Window.partitionBy())).cast("long")
    cuts = per_key.withColumn("q", q)
    ok = F.filter("l", lambda x: x["upto"] <= F.col("q"))
    below = F.coalesce(F.array_max(F.transform(ok, lambda x: x["upto"])), F.lit(0))
    on = F.array_min(F.transform(F.filter("l", lambda x: x["upto"] > F.col("q")), lambda x: x["__b"]))
    cuts = cuts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                       F.coalesce(on, F.lit(buckets)).alias("__cut"), (F.col("q") - below).alias("__rest"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    if not keys:
        h, cuts, cond = h.withColumn("__one", F.lit(1)), cuts.withColumn("__uno", F.lit(1)), F.col("__one") == F.col("__uno")
    # one row per key, and keys are classes: labels, targets, or none at all
    j = h.join(F.broadcast(cuts), cond)
    sure = j.where(F.col("__b") != F.col("__cut")).withColumn("taken", F.col("__b") < F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", id_col))
    edge = j.where(F.col("__b") == F.col("__cut")).withColumn("taken", rank <= F.col("__rest"))
    cols = [*df.columns, "taken"]
    return sure.select(*cols).unionByName(edge.select(*cols))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", share: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Adds ``part``: the first floor(share·n) rows of every label are ``train``."""
    d = seeded_take(df, [label], id_col, seed, lambda total, _: F.floor(total * share))
    return d.withColumn("part", F.when(F.col("taken"), "train").otherwise("test")).drop("taken")


def random_split(df: DataFrame, id_col: str = "id", share: float = 0.8, seed: int = 42) -> DataFrame:
    d = seeded_take(df, [], id_col, seed, lambda total, _: F.floor(total * share), buckets=65536)
    return d.withColumn("part", F.when(F.col("taken"), "train").otherwise("test")).drop("taken")


def balanced_sample(df: DataFrame, target: str = "target", id_col: str = "id", seed: int = 42,
                    minimum: int = 10) -> DataFrame:
    """As many rows of each class as the smaller one has; empty below ``minimum``."""
    d = seeded_take(df, [target], id_col, seed,
                    lambda _, small: F.when(small >= minimum, small).otherwise(0))
    return d.where("taken").drop("taken")


def merge_datasets(dfs: list[DataFrame], max_total: int | None = None, redacted: bool = True, seed: int = 42,
                   id_col: str = "id") -> DataFrame:
    """Union by name, a seeded random choice of ``max_total`` rows if given, then redaction."""
    from tierflow.operators.redact import redact
    d = dfs[0]
    for other in dfs[1:]:
        d = d.unionByName(other, allowMissingColumns=True)
    if max_total is not None:
        d = seeded_take(d, [], id_col, seed, lambda *_: F.lit(max_total), buckets=65536).where("taken").drop("taken")
    return redact(d, "text").withColumn("anonymized", F.lit(True)) if redacted else d


def training_union(generated: DataFrame, instructions: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    d = generated.unionByName(instructions, allowMissingColumns=True)
    return d if custom is None else d.unionByName(custom, allowMissingColumns=True)


# --- synthetic prompts ---------------------------------------------------------------
def _pick(values, seed_value: Column, salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (uniform_hash(seed_value, salt) % len(values) + 1).cast("int"))


def _filled(template: Column, pools: dict, key: Column, seed, rest: str) -> Column:
    text = template
    for slot, values in pools.items():
        text = F.replace(text, F.lit("{" + slot + "}"), _pick(values, key, f"{seed}{slot}"))
    return F.regexp_replace(text, r"\{[^}]+\}", rest)


def generate_prompts(ids: DataFrame, id_col: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """A prompt for each id and its label (``trivial`` or ``light``), reproducible from id
    and seed. Unfilled slots become ``something`` or ``data``."""
    key = F.col(id_col)
    trivial = _filled(_pick(V.TRIVIAL_TEMPLATES, key, f"{seed}template"), V.TRIVIAL_POOLS, key, seed, "something")
    light = _filled(_pick(V.LIGHT_TEMPLATES, key, f"{seed}template"), V.LIGHT_POOLS, key, seed, "data")
    is_trivial = F.col(label) == "trivial"
    d = ids.withColumn("text", F.when(is_trivial, trivial).otherwise(light))
    return (d.withColumn("sample_id", T.sample_id(F.lit("synthetic"), key, F.col("text")))
            .withColumn("source", F.lit("gpd-synthetic")).withColumn("domain", F.lit("general"))
            .withColumn("confidence", F.when(is_trivial, 0.95).otherwise(0.90))
            .withColumn("intent", F.when(is_trivial | (unit_hash(key, f"{seed}intent") < 0.5), "query")
                        .otherwise("command")))


def generate_range(spark, n_trivial: int, n_light: int, seed: int = 42) -> DataFrame:
    """The same from nothing but two counts."""
    ids = spark.range(n_trivial + n_light).withColumn(
        "label", F.when(F.col("id") < n_trivial, "trivial").otherwise("light"))
    return generate_prompts(ids, seed=seed)


def generate_graded(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Prompts for all six tiers with an occasional suffix and prefix."""
    key = F.col(id_col)
    tier = S.tier_at(key % 6)
    base = F.lit(None).cast("string")
    for t in V.TIERS:
        base = F.when(F.col("tier") == t, _pick(V.GRADED_PROMPTS[t], key, f"{seed}base")).otherwise(base)
    d = ids.withColumn("tier", tier).withColumn("__b", base)
    text = F.when(unit_hash(key, f"{seed}suffix") < 0.3, F.concat("__b", F.lit(V.GRADED_SUFFIX))).otherwise(F.col("__b"))
    d = d.withColumn("__t", text)
    return d.withColumn("text", F.when(unit_hash(key, f"{seed}prefix") < 0.2, F.concat(
        F.lit(V.GRADED_PREFIX), F.lower("__t"))).otherwise(F.col("__t"))).drop("__b", "__t")


def generate_dataset(ids: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(generated rows with their part, statistics)."""
    from tierflow.functions.features import generator_features
    d = random_split(generate_prompts(ids, seed=seed), seed=seed)
    return d, dataset_stats(generator_features(d))


# --- calibration ------------------------------------------------------------------------
def exact_quantiles(df: DataFrame, value: str, points: list[float], cells: int = 4096) -> DataFrame:
    """One row with interpolated quantiles q0, q1, ... of a value in [0, 1]. Equal values are
    folded first; ranks come from value cells, so no task sees all values."""
    from tierflow.operators.scale import running
    d = staged(df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    d = running(d, [], ["v"], F.floor(F.col("v") * cells), sums={"upto": F.col("n")}, totals={"total": F.col("n")})
    aggs = []
    for i, p in enumerate(points):
        pos = (F.col("total") - 1) * p
        for name, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"{name}{i}"))
    s = d.agg(F.max("total").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"),
              (F.sum(F.col("v") * F.col("n")) / F.max("total")).alias("mean"), *aggs)
    out = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * ((F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)))
           .alias(f"q{i}") for i, p in enumerate(points)]
    return s.select("total", "min", "max", "mean", *out)


def calibrate_bounds(df: DataFrame, score: str = "score", approximate: bool = False) -> DataFrame:
    """Tier bounds at 5/20/45/70/90 %, with minimum, maximum, median and mean. Exact by
    default; ``approximate`` takes one pass with percentile_approx."""
    points = [0.05, 0.20, 0.45, 0.70, 0.90, 0.5]
    names = ["light_from", "moderate_from", "heavy_from", "intensive_from", "extreme_from", "median"]
    if approximate:
        q = F.percentile_approx(score, points, 10000)
        return df.agg(F.count(F.lit(1)).alias("total"), F.min(score).alias("min"), F.max(score).alias("max"),
                      F.avg(score).alias("mean"), q.alias("q")).select(
            "total", "min", "max", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    d = exact_quantiles(df, score, points)
    return d.select("total", "min", "max", "mean", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])

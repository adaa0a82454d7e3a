"""Keyword retrieval from the history index.

The index forgets rows older than the TTL; a caller may also ask for its newest ``max_entries`` only. Entries with
equal term sets are looked up as one set, and queries with equal keyword lists as one profile, so neither copies of
entries nor of queries multiply the work. Blocks of profiles meet blocks of sets; a task counts the matches of its two
blocks and hands on the best sets of each profile, so no (profile, set) pair is shuffled. All tables grow with the
input, so every join shuffles both sides and none is broadcast through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S
from tierflow.operators.feedback import keep_latest
from tierflow.operators.scale import sorted_join, staged, top_per_key

MAX_ENTRIES = None
TTL_MS = 86400000
BLOCK_PROFILES = 32768
BLOCK_SETS = 65536
MATCHES_AT_ONCE = 1 << 21


def live_index(index: DataFrame, now=None, ttl=TTL_MS, max_entries: int | None = MAX_ENTRIES,
               created: str = "created", key: str = "entry_id") -> DataFrame:
    """Newest entries inside the TTL."""
    kept = index if max_entries is None else keep_latest(index, max_entries, created, key)
    return kept if now is None else kept.where(F.lit(now) - F.col(created) < ttl)


def _grams(c):
    """All substrings of one to four characters."""
    return F.array_distinct(F.flatten(F.transform(
        F.array(*[F.lit(n) for n in (1, 2, 3, 4)]),
        lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                              lambda i: F.substring(c, i, n)))))


def containment_pairs(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(kw, term) where either contains the other, from two distinct vocabularies.

    The head of the shorter string (four characters, or all of it) is a substring of the
    longer one, so both directions are equi-joins on that head; ``contains`` then decides.
    """
    head = lambda c: F.substring(c, 1, 4)
    kw, term = F.col("kw"), F.col("term")
    inside_term = sorted_join(words.select(kw, head(kw).alias("g")),
                              terms.select(term, F.explode(_grams(term)).alias("g")), "g").where(term.contains(kw))
    inside_kw = sorted_join(words.select(kw, F.explode(_grams(kw)).alias("g")),
                            terms.select(term, head(term).alias("g")), "g").where(kw.contains(term))
    return inside_term.select("kw", "term").union(inside_kw.select("kw", "term")).distinct()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each list, and all items."""
    c = column.combine_chunks()
    sizes = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, c.flatten().to_numpy(zero_copy_only=False)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the items of the given lists, one list after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _best_sets(k: int, at_once: int = MATCHES_AT_ONCE) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of profiles with their keywords' terms and a block of sets: the k best sets of each profile. Set
    numbers follow the order of ties. Profiles are counted in groups of about ``at_once`` matches."""

    def best(asked: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.sort_by("s")
        number, n_sets = sets["s"].to_numpy(), sets.num_rows
        _, sizes, flat = _lists(sets["ids"])
        order = np.argsort(flat, kind="stable")
        posting = np.repeat(np.arange(n_sets), sizes)[order]
        terms, t_start, t_size = np.unique(flat[order], return_index=True, return_counts=True)

        words = asked.filter(pc.is_valid(asked["w"])).sort_by("w")
        _, w_size, w_term = _lists(words["ids"])
        at = np.searchsorted(terms, w_term)
        here = at < len(terms)
        here[here] = terms[at[here]] == w_term[here]
        owner, w_term = np.repeat(np.arange(len(w_size)), w_size)[here], at[here]
        w_size = np.bincount(owner, minlength=len(w_size))
        w_start = np.cumsum(w_size) - w_size
        w_matches = np.bincount(owner, t_size[w_term], minlength=len(w_size)).astype(np.int64)

        profiles = asked.filter(pc.is_valid(asked["p"]))
        profile = profiles["p"].to_numpy()
        p_start, p_size, flat = _lists(profiles["ids"])
        p_word = np.searchsorted(words["w"].to_numpy(), flat)
        matches = np.bincount(np.repeat(np.arange(len(p_size)), p_size), w_matches[p_word], minlength=len(p_size))
        group = np.cumsum(matches) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(p_size)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            who = np.repeat(np.arange(lo, hi), p_size[lo:hi])
            word = p_word[_places(p_start[lo:hi], p_size[lo:hi])]
            term = w_term[_places(w_start[word], w_size[word])]
            item = np.repeat(np.repeat(np.arange(len(word)), w_size[word]), t_size[term])
            # a keyword counts once a set, whatever number of the set's terms it matches
            hit = np.unique(item * n_sets + posting[_places(t_start[term], t_size[term])])
            pair, score = np.unique(who[hit // n_sets] * n_sets + hit % n_sets, return_counts=True)
            if not len(pair):
                continue
            top = score.max()
            rank = np.sort((pair // n_sets * (top + 1) + top - score) * n_sets + pair % n_sets)
            p = rank // (n_sets * (top + 1))
            rank = rank[np.arange(len(p)) - np.searchsorted(p, p) < k]
            p, s = rank // n_sets // (top + 1), rank % n_sets
            out.append((profile[p], number[s], top - rank // n_sets % (top + 1)))
        p, s, score = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"p": p, "s": s, "score": score.astype(np.int64)})

    return best


def retrieve(queries: DataFrame, index: DataFrame, k: int = 3, now=None, ttl=TTL_MS,
             max_entries: int | None = MAX_ENTRIES, query_id: str = "query_id", keywords: str = "keywords",
             created: str = "created", key: str = "entry_id") -> DataFrame:
    """(query_id, rank, score, entry_id): the k entries with most matching keywords.

    A keyword matches an entry when one of the entry's terms contains it or is contained
    in it. Ties go to the older entry. Repeated keywords of a query count each time.
    """
    numbered = lambda df, n: staged(df.withColumn(n, F.monotonically_increasing_id()))
    entries = live_index(index, now, ttl, max_entries, created, key)
    terms = F.array_sort(F.array_distinct(F.concat("keywords", "tags")))
    held = entries.select(F.col(key).alias("e"), F.col(created).alias("c"), terms.alias("terms"))
    held = staged(held.withColumn("set", F.md5(F.to_json("terms"))))
    # of one set only its k oldest entries can be among the k best
    oldest = top_per_key(held.select("set", "c", "e"), ["set"], [F.col("c"), F.col("e")], k).drop("rank")
    ranges = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = held.groupBy("set", "terms").agg(F.min(F.struct("c", "e")).alias("p"))
    sets = numbered(sets.repartitionByRange(ranges, "p.c", "p.e").sortWithinPartitions("p.c", "p.e"), "s")
    postings = sets.select("s", F.explode("terms").alias("term"))
    vocabulary = numbered(postings.select("term").distinct(), "t")

    # equal keyword lists are one profile; copies of a prompt cost one lookup
    profiled = staged(queries.select(F.col(query_id).alias("q"), F.col(keywords).alias("kws")))
    profiles = numbered(profiled.select("kws").distinct(), "p")
    lists = profiles.select("p", F.explode("kws").alias("kw"))
    words = numbered(lists.select("kw").distinct(), "w")
    pairs = sorted_join(containment_pairs(words.select("kw"), vocabulary.select("term")), words, "kw")
    pairs = staged(sorted_join(pairs, vocabulary, "term").groupBy("w").agg(F.collect_list("t").alias("ids")))

    # every block of profiles meets every block of sets; only their best sets leave a task
    of_profiles = max(held.sparkSession.sparkContext.defaultParallelism, math.ceil(profiles.count() / BLOCK_PROFILES))
    of_sets = max(1, math.ceil(sets.count() / BLOCK_SETS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = staged(sorted_join(sorted_join(lists, words, "kw"), pairs.select("w"), "w")
                   .select("p", "w", block("p", of_profiles).alias("bp")))
    none = F.lit(None).cast("long")
    asked = (lists.groupBy("bp", "p").agg(F.collect_list("w").alias("ids")).select("bp", "p", none.alias("w"), "ids")
             .unionByName(sorted_join(lists.select("bp", "w").distinct(), pairs, "w").select("bp", none.alias("p"), "w", "ids")))
    of_set = sorted_join(postings, vocabulary, "term").groupBy("s").agg(F.collect_list("t").alias("ids"))
    tasks = 4 * of_profiles * of_sets
    asked = asked.withColumn("bs", each(of_sets)).repartition(tasks, "bp", "bs")
    of_set = (of_set.withColumn("bs", block("s", of_sets)).withColumn("bp", each(of_profiles)).repartition(tasks, "bp", "bs"))
    count = _best_sets(k)
    scored = asked.groupBy("bp", "bs").cogroup(of_set.groupBy("bp", "bs")).applyInArrow(
        lambda a, b: count(a, b), "p long, s long, score long")
    # k sets hold the k best entries: each better set has an entry that is better too
    near = top_per_key(scored, ["p"], [F.col("score").desc(), F.col("s")], k).drop("rank")
    near = sorted_join(near, sets.select("s", "set"), "s").drop("s")
    top = top_per_key(sorted_join(near, oldest, "set"), ["p"], [F.col("score").desc(), F.col("c"), F.col("e")], k)
    return sorted_join(sorted_join(profiled, profiles, "kws"), top, "p").select(
        F.col("q").alias(query_id), F.col("rank").cast("long").alias("rank"), "score", F.col("e").alias(key))


def retrieval_signal(queries: DataFrame, index: DataFrame, variant: str = "scorer", k: int = 5,
                     **options) -> DataFrame:
    """Mean tier value of the retrieved entries, .5 without any. ``voter`` takes .5 for
    unknown tiers and adds .1 when an entry was inadequate."""
    got = retrieve(queries, index, k, **options)
    entries = live_index(index, options.get("now"), options.get("ttl", TTL_MS),
                         options.get("max_entries", MAX_ENTRIES))
    value = S.tier_value(F.col("tier"), V.RETRIEVAL_TIER_VALUES, 0.3 if variant == "scorer" else 0.5)
    e = entries.select("entry_id", value.alias("v"), (F.col("adequacy") < 0.6).alias("weak"))
    s = sorted_join(got, e, "entry_id").groupBy("query_id").agg(
        F.avg("v").alias("mean"), F.max(F.col("weak").cast("int")).alias("weak"))
    signal = F.col("mean") if variant == "scorer" else F.when(F.col("mean").isNotNull(), F.least(
        F.lit(1.0), F.col("mean") + F.when(F.col("weak") == 1, 0.1).otherwise(0.0)))
    return sorted_join(queries.select("query_id"), s, "query_id", "left").select(
        "query_id", F.coalesce(signal, F.lit(0.5)).alias("retrieval"))


def consensus_label(queries: DataFrame, index: DataFrame, min_agreement: int = 3, **options) -> DataFrame:
    """Tier on which three and more than 60 % of the ten best entries agree; ties go to the
    tier met first."""
    got = retrieve(queries, index, 10, **options)
    entries = live_index(index, options.get("now"), options.get("ttl", TTL_MS),
                         options.get("max_entries", MAX_ENTRIES)).select("entry_id", "tier")
    n = (sorted_join(got, entries, "entry_id").groupBy("query_id", "tier")
         .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")))
    best = n.groupBy("query_id").agg(F.sum("n").alias("found"),
                                     F.max(F.struct("n", (-F.col("first")).alias("f"), "tier")).alias("b"))
    ok = (F.col("found") >= min_agreement) & (F.col("b.n") >= min_agreement) & (F.col("b.n") / F.col("found") > 0.6)
    return best.where(ok).select("query_id", F.col("b.tier").alias("label"), F.col("b.n").alias("agree"), "found")


def context_notes(queries: DataFrame, index: DataFrame, k: int = 3, **options) -> DataFrame:
    """Retrieved summaries of each query joined into one note."""
    from tierflow.functions import text as T
    got = retrieve(queries, index, k, **options)
    e = live_index(index, options.get("now"), options.get("ttl", TTL_MS),
                   options.get("max_entries", MAX_ENTRIES)).select(
        "entry_id", T.context_note(F.col("original_role"), F.col("summary")).alias("line"))
    lines = sorted_join(got, e, "entry_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("query_id", F.concat(F.lit(T.CONTEXT_HEADER), F.array_join(F.col("l.line"), "\n"))
                        .alias("context_note"))


def intent_score(prompts: DataFrame, index: DataFrame, feedback: DataFrame, **options) -> DataFrame:
    """Gateway features, heuristic, retrieval signal and history bias into one vote.
    ``prompts`` has query_id, keywords and text."""
    from tierflow.functions.features import gateway_features
    from tierflow.operators.feedback import history_bias_now
    scored = gateway_features(prompts).select("query_id", S.gateway_heuristic().alias("heuristic"))
    signal = retrieval_signal(prompts, index, "scorer", **options)
    bias = history_bias_now(feedback)  # one row, joined on a constant
    d = (sorted_join(scored, signal, "query_id").withColumn("__k", F.lit(1))
         .join(F.broadcast(bias.withColumn("__k", F.lit(1))), "__k").drop("__k"))
    return S.ensemble_vote(d)

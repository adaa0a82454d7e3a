"""Conversation compaction and clean-up as ordered work per session.

A session may be very long, so no step collects it: positions, totals and the message
before come from ``scale.running`` over message ranges, and the two trimming loops are
cumulative sums. Input: session_id, pos, role, text, tool_calls, tool_call_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions import text as T
from tierflow.operators.routing import kv_bytes, with_window
from tierflow.operators.scale import position_bucket, running, staged

KEY, POS = "session_id", "pos"


def _one() -> Column:
    return F.lit(1).cast("long")


def _ordered(df: DataFrame, **kw) -> DataFrame:
    """Ranges of 4096 positions per session: short sessions stay in one piece."""
    return running(df, [KEY], [POS], position_bucket(F.col(POS)), **kw)


def has_calls(calls: str = "tool_calls") -> Column:
    return F.coalesce(F.size(calls) > 0, F.lit(False))


def message_tokens() -> Column:
    return T.est_tokens(F.col("text"), F.coalesce(F.length(F.to_json("tool_calls")), F.lit(0)))


def budget(df: DataFrame, model: str = "model") -> DataFrame:
    """Reserve, input limit and compaction threshold of the target model."""
    w = F.col("context_window")
    d = with_window(df, model)
    d = d.withColumn("reserved", F.greatest(F.lit(4096), F.least(F.lit(16384), F.floor(w * 0.1))).cast("long"))
    d = d.withColumn("max_input", F.col("context_window") - F.col("reserved"))
    return d.withColumn("threshold", F.least(F.lit(32000), F.lit(50000),
                                             F.greatest(F.lit(4000), F.floor(F.col("max_input") * 0.05))).cast("long"))


def cap_messages(df: DataFrame, limit: int = 60, keep_last: int = 30) -> DataFrame:
    """Above ``limit`` messages: old assistant messages and whole old tool-call chains go;
    system, user and the last ``keep_last`` messages stay. One pass."""
    head = F.when(F.col("role") != "tool", F.struct(
        F.col(POS).alias("p"), ((F.col("role") == "assistant") & has_calls()).alias("calls")))
    d = _ordered(df, sums={"__i": _one()}, totals={"__n": _one()}, previous={"__head": head})
    # a chain that reaches into the kept tail stays whole: only the one across the cut can
    at_cut = F.col("__i") == F.col("__n") - keep_last + 1
    d = _ordered(d, totals={"__cut": F.when(at_cut, F.col(POS)), "__across": F.when(
        at_cut & (F.col("role") == "tool"), F.col("__head.p"))})
    cut = F.col("__cut")
    start = F.least(cut, F.coalesce("__across", cut))
    in_chain = (F.col("role") == "tool") & F.coalesce(F.col("__head.calls"), F.lit(False))
    old_plain = (F.col("role") == "assistant") & ~has_calls() & (F.col(POS) < cut)
    old_head = (F.col("role") == "assistant") & has_calls() & (F.col(POS) < start)
    old_tool = in_chain & (F.col("__head.p") < start)
    return d.where(~((F.col("__n") > limit) & (old_plain | old_head | old_tool))).select(*df.columns)


ROLES = ["system", "user", "assistant", "tool"]


def with_runs(df: DataFrame, **kw) -> DataFrame:
    """Adds ``__run``: the position of the last message of another role. It is the same for
    all messages of a run and differs between runs of one role, so one pass is enough."""
    other = {f"__o_{r}": F.when(F.col("role") != r, F.col(POS)) for r in ROLES}
    d = _ordered(df, previous=other, **kw)
    run = F.lit(None).cast("long")
    for r in ROLES:
        run = F.when(F.col("role") == r, F.col(f"__o_{r}")).otherwise(run)
    return d.withColumn("__run", F.coalesce(run, F.lit(-1))).drop(*other)


def merge_runs(df: DataFrame, extra: list[str] | None = None, calls: str = "all") -> DataFrame:
    """Consecutive messages of one role become one, texts joined by a separator. Keeps the
    first position, the first tool_call_id and all tool calls, or only those of the first
    message (``calls='first'``). ``extra`` columns are constant within a session."""
    extra = extra or []
    d = df if "__run" in df.columns else with_runs(df)
    part = F.struct(POS, "text", "tool_calls", "tool_call_id")
    g = d.groupBy(KEY, "__run", "role").agg(
        F.array_sort(F.collect_list(part)).alias("m"), F.count(F.lit(1)).alias("merged"),
        *[F.first(c).alias(c) for c in extra])
    ids = F.filter(F.transform("m", lambda x: x["tool_call_id"]), lambda x: x.isNotNull())
    every = F.flatten(F.filter(F.transform("m", lambda x: x["tool_calls"]), lambda x: x.isNotNull()))
    kept = F.when(F.size(every) > 0, every) if calls == "all" else F.col("m")[0]["tool_calls"]
    return g.select(
        KEY, F.col("m")[0]["pos"].alias(POS), "role",
        F.array_join(F.transform("m", lambda x: x["text"]), V.RUN_SEPARATOR).alias("text"),
        kept.alias("tool_calls"), F.get(ids, F.lit(0)).alias("tool_call_id"),
        "merged", *extra)


def _word_in(words) -> Column:
    return F.col("text").rlike(f"(?i){T.ASCII_START}{T.alternatives(words)}{T.ASCII_END}")


def message_importance(df: DataFrame, recency: str = "reference") -> DataFrame:
    """Adds idx (0-based), n, radius and angle. ``recency='reference'`` gives the oldest
    message the highest share; ``'newest'`` turns it round."""
    calls = (F.col("role") == "assistant") & has_calls()
    d = _ordered(df, sums={"idx": _one()}, totals={"n": _one()}, previous={"__was": calls})
    d = d.withColumn("idx", F.col("idx") - 1)
    d = d.withColumn("tags", T.topic_tags(F.col("text")))
    share = F.col("idx") / F.col("n")
    fresh = F.greatest(F.lit(0.0), 1.0 - share) if recency == "reference" else share
    decision, error = _word_in(V.DECISION_WORDS), _word_in(V.ERROR_WORDS)
    role = F.col("role")
    tool = F.col("tool_call_id").isNotNull() | (role == "tool")
    w = lambda c, v: F.when(c, v).otherwise(0.0)
    d = d.withColumn("__dec", decision).withColumn("__err", error)
    radius = (fresh * 0.25 + F.when(tool, 0.15).otherwise(0.03)
              + w((role == "assistant") & has_calls(), 0.20) + w(F.col("__dec"), 0.15) + w(F.col("__err"), 0.10)
              + w(role == "system", 0.15) + w(role == "user", 0.10) + T.semantic_importance(F.col("tags")) * 0.25)
    angle = (F.when(role == "system", "system").when(role == "user", "user").when(tool, "tool")
             .when(F.col("__dec") | F.col("__err"), "decision").otherwise("assistant"))
    return d.withColumn("radius", F.least(radius, F.lit(1.0))).withColumn("angle", angle).drop(
        "__dec", "__err")


def protect_chains(df: DataFrame) -> DataFrame:
    """Marks assistant messages with calls, the tool message behind them and tool messages
    with a call id. Expects merged messages."""
    calls = (F.col("role") == "assistant") & has_calls()
    d = df if "__was" in df.columns else _ordered(df, previous={"__was": calls})
    tool = (F.col("role") == "tool") & (F.coalesce("__was", F.lit(False)) | F.col("tool_call_id").isNotNull())
    return d.withColumn("protected", calls | tool).drop("__was")


def assign_level(ratio: Column, recent: int = 3) -> Column:
    """Q8 whole, Q4 without thinking, Q2 two sentences, Q1 key facts."""
    r, a = F.col("radius"), F.col("angle")
    ladder = lambda q8, q4, q2: F.when(r > q8, "Q8").when(r > q4, "Q4").when(r > q2, "Q2").otherwise("Q1")
    by_budget = (F.when(ratio > 0.7, ladder(0.5, 0.3, 0.15)).when(ratio > 0.4, ladder(0.6, 0.4, 0.2))
                 .when(ratio > 0.2, ladder(0.7, 0.5, 0.3))
                 .otherwise(F.when(r > 0.8, "Q4").when(r > 0.5, "Q2").otherwise("Q1")))
    keep = (a == "system") | (F.col("idx") >= F.col("n") - recent) | (a == "tool") | F.col("protected")
    return F.when(keep, "Q8").when(a == "user", F.when(r > 0.5, "Q8").otherwise("Q4")).otherwise(by_budget)


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[.!?]+"), lambda x: x != "")


KEY_FACT = rf"(?i){T.ASCII_START}{T.alternatives(V.KEY_FACT_WORDS)}{T.ASCII_END}[^.!?]*[.!?]?"


def apply_level(df: DataFrame) -> DataFrame:
    """Shortened text per level; adds entry_tier and entry_summary for the retrieval store
    (null when nothing is stored). A null text means the message leaves the context."""
    t = F.col("text")
    fixed = (F.col("role") == "tool") | ((F.col("role") == "assistant") & has_calls())
    d = df.withColumn("__two", T.strip(F.array_join(F.slice(_sentences(t), 1, 2), ". ")))
    d = d.withColumn("__one", T.strip(F.coalesce(F.get(_sentences(t), F.lit(0)), F.lit(""))))
    d = d.withColumn("__facts", F.regexp_extract_all(t, F.lit(KEY_FACT), F.lit(0)))
    facts = F.array_join(F.slice("__facts", 1, 2), " ")
    q2 = ~fixed & (F.col("level") == "Q2")
    q1 = ~fixed & (F.col("level") == "Q1") & F.col("tool_call_id").isNull()
    some = F.size("__facts") > 0
    empty = lambda c: F.nullif(c, F.lit(""))
    return (d.withColumn("text", F.when(q2, empty(F.col("__two")))
                         .when(q1 & some, facts).when(q1, empty(F.col("__one"))).otherwise(t))
            .withColumn("entry_tier", F.when(q2, F.when(F.col("__two") == "", "Q0").otherwise("Q2")).when(q1, "Q1"))
            .withColumn("entry_summary", F.when(q2, F.coalesce(empty(F.col("__two")), F.lit("(empty message)")))
                        .when(q1 & some, facts)
                        .when(q1, F.coalesce(empty(F.col("__one")), F.lit("(no key facts)"))))
            .drop("__two", "__one", "__facts"))


def trim_to_budget(df: DataFrame, recent: int = 3, protect_users: bool = False) -> DataFrame:
    """Second and third pass. Message i is cut to its first sentence iff the total less the
    savings of earlier eligible messages is still above the threshold; the same form, with
    assistant tokens, then drops the oldest assistants above the input limit.
    Expects threshold and max_input; marks dropped rows."""
    sentences = _sentences(F.col("text"))
    roles = ["system", "user"] if protect_users else ["system"]
    candidate = ~F.col("role").isin(roles) & (F.length("text") > 80) & (F.size(sentences) > 1)
    calls = F.coalesce(F.length(F.to_json("tool_calls")), F.lit(0))
    d = df.withColumn("__cut", F.when(candidate, T.strip(sentences[0]))).withColumn("__tok", message_tokens())
    d = d.withColumn("__save", F.when(F.col("__cut").isNotNull(),
                                      F.col("__tok") - T.est_tokens(F.col("__cut"), calls)).otherwise(0))
    # the last rows are no candidates, but nothing later counts their savings
    d = _ordered(d, sums={"__i": _one(), "__saved": F.col("__save")},
                 totals={"__n": _one(), "__total": F.col("__tok")}).withColumn("__i", F.col("__i") - 1)
    over = (F.col("__total") - (F.col("__saved") - F.col("__save")) > F.col("threshold")) \
        & (F.col("__i") < F.col("__n") - recent)
    d = d.withColumn("trimmed", over & F.col("__cut").isNotNull())
    d = d.withColumn("text", F.when(F.col("trimmed"), F.col("__cut")).otherwise(F.col("text")))
    d = d.withColumn("__tok", message_tokens())
    old = (F.col("role") == "assistant") & (F.col("__i") < F.col("__n") - recent)
    d = d.withColumn("__drop", F.when(F.col("role") == "assistant", F.col("__tok")).otherwise(0))
    d = _ordered(d, sums={"__gone": F.col("__drop")}, totals={"__now": F.col("__tok")})
    out = old & (F.col("__now") - (F.col("__gone") - F.col("__drop")) > F.col("max_input"))
    return d.withColumn("dropped", out).select(*df.columns, "trimmed", "dropped")


def compact(df: DataFrame, model: str, recency: str = "reference",
            protect_users: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, entries): all steps for one target model. Messages carry their level and
    the flags ``kept``, ``trimmed`` and ``dropped``; entries go to the retrieval store."""
    d = budget(cap_messages(df).withColumn("model", F.lit(model))).drop("model", "reserved")
    d = staged(d.withColumn("__t", message_tokens()))
    d = with_runs(d, totals={"original_tokens": F.col("__t"), "__n": _one()}).drop("__t")
    quiet = (F.col("original_tokens") <= F.col("threshold")) | (
        (F.col("__n") <= 5) & (F.col("original_tokens") <= 8000))
    session = ["context_window", "kv_per_1k", "max_input", "threshold", "original_tokens"]
    plain = d.where(quiet).select(
        KEY, POS, "role", "text", "tool_calls", "tool_call_id", *session, F.lit("Q8").alias("level"),
        F.lit(False).alias("trimmed"), F.lit(False).alias("dropped"))
    busy = d.where(~quiet).drop("__n")
    m = merge_runs(busy, session).drop("merged")
    m = protect_chains(message_importance(m, recency))
    ratio = F.col("threshold") / F.greatest(F.lit(1), F.col("original_tokens"))
    m = staged(apply_level(m.withColumn("level", assign_level(ratio))))
    entries = compaction_entries(m)
    rest = m.where(F.col("text").isNotNull()).select(*[c for c in plain.columns if c not in ("trimmed", "dropped")])
    done = trim_to_budget(rest, protect_users=protect_users)
    gone = m.where(F.col("text").isNull()).select(
        KEY, POS, "role", "text", "tool_calls", "tool_call_id", *session, "level",
        F.lit(False).alias("trimmed"), F.lit(True).alias("dropped"))
    return plain.unionByName(done).unionByName(gone), entries


def compaction_summary(messages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Totals per session: tokens, ratio, level counts and cache bytes."""
    live = ~F.col("dropped")
    levels = [F.sum((F.col("level") == q).cast("long")).alias(q.lower()) for q in ["Q8", "Q4", "Q2", "Q1"]]
    d = messages.groupBy(KEY).agg(
        F.sum(live.cast("long")).alias("messages"), F.max("original_tokens").alias("original_tokens"),
        F.sum(F.when(live, message_tokens()).otherwise(0)).alias("compressed_tokens"), *levels,
        F.sum((F.col("dropped") & F.col("text").isNotNull()).cast("long")).alias("q0"),
        F.sum(F.col("trimmed").cast("long")).alias("trimmed"), F.max("kv_per_1k").alias("__kv"))
    d = (d.withColumn("ratio", F.col("original_tokens") / F.greatest(F.lit(1), F.col("compressed_tokens")))
         .withColumn("kv_bytes", kv_bytes(F.col("compressed_tokens"), F.col("__kv"))).drop("__kv"))
    if entries is None:
        return d
    n = entries.groupBy(KEY).agg(F.count(F.lit(1)).alias("entries_stored"))
    return d.join(n, KEY, "left").na.fill(0, ["entries_stored"])


def compaction_entries(levelled: DataFrame) -> DataFrame:
    """Retrieval entries of shortened messages; tags double as keywords."""
    return levelled.where(F.col("entry_tier").isNotNull()).select(
        KEY, POS, F.col("role").alias("original_role"), F.col("entry_summary").alias("summary"),
        F.col("tags").alias("keywords"), "tags", F.col("entry_tier").alias("tier"),
        F.lit(1.0).alias("adequacy"), F.lit("").alias("model_used"),
        F.lit(0).cast("long").alias("original_tokens"), F.lit(0).cast("long").alias("compressed_tokens"))


def interaction_entries(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Retrieval entry of a finished interaction."""
    return df.select(
        "id", T.keywords(F.col(prompt)).alias("keywords"), F.array().cast("array<string>").alias("tags"),
        F.col("predicted_tier").alias("tier"), "model_used", F.lit(1.0).alias("adequacy"),
        F.substring(response, 1, 200).alias("summary"), F.col("tokens_in").alias("original_tokens"),
        F.col("compressed_tokens"))


def sanitise(df: DataFrame) -> DataFrame:
    """A sequence every provider accepts: systems first, runs merged, starting at a user
    message, no empty and no orphaned tool messages, at least one user message.

    ``pos`` is renumbered from 0. After merging, a tool message may stay only right behind
    an assistant message, which is the kept row before it: no fold is needed.
    """
    sized = _ordered(df, totals={"__n": _one()})
    alone = sized.where(F.col("__n") <= 1).select(KEY, POS, "role", "text", "tool_calls", "tool_call_id",
                                                  F.lit(1).alias("__part"))
    many = sized.where(F.col("__n") > 1).drop("__n")
    system = many.where(F.col("role") == "system").select(
        KEY, POS, "role", "text", "tool_calls", "tool_call_id", F.lit(0).alias("__part"))
    runs = merge_runs(many.where(F.col("role") != "system"), calls="first").drop("merged")
    # everything before the first user message goes, if there is one behind the start
    first_user = F.when(F.col("role") == "user", F.col(POS))
    runs = _first(runs, first_user, "__u")
    runs = runs.where(F.col("__u").isNull() | (F.col(POS) >= F.col("__u"))).drop("__u")
    body = runs.select(KEY, POS, "role", "text", "tool_calls", "tool_call_id", F.lit(1).alias("__part"))
    rows = staged(system.unionByName(body))
    # a tool message needs a parent among the calls that survived the merge
    ids = rows.where((F.col("role") == "assistant") & has_calls()).select(
        F.col(KEY).alias("__ks"), F.explode("tool_calls").alias("__c")).select("__ks", F.col("__c.id").alias("__cid")).distinct()
    rows = rows.join(ids, (F.col(KEY) == F.col("__ks")) & (F.col("tool_call_id") == F.col("__cid")), "left")
    anchor = (F.col("role") == "assistant") & has_calls()
    blank = (F.coalesce(T.strip(F.col("text")), F.lit("")) == "") & ~anchor
    orphan = (F.col("role") == "tool") & F.col("tool_call_id").isNotNull() & F.col("__cid").isNull()
    rows = rows.where(~blank & ~orphan).drop("__ks", "__cid")
    # order: systems, then the rest. A tool message stays only behind an assistant; rows in
    # front of the first system or user row go. Neither rule removes a system or user row,
    # so one pass serves both.
    order = ["__part", POS]
    slot = F.col("__part") * 1000000000000 + position_bucket(F.col(POS))
    anchor_row = F.col("role").isin("system", "user")
    rows = running(rows, [KEY], order, slot, previous={"__before": F.col("role")},
                   sums={"__good": F.when(anchor_row, 1).otherwise(0).cast("long")})
    behind = (F.col("role") != "tool") | F.coalesce(F.col("__before") == "assistant", F.lit(False))
    rows = staged(rows.where(behind & (F.col("__good") > 0)).drop("__before", "__good"))
    # a session without user rows gets one behind its system rows
    lost = many.select(KEY).distinct().join(
        rows.where(F.col("role") == "user").select(KEY).distinct(), KEY, "left_anti")
    filler = lost.select(KEY, F.lit(-1).cast("long").alias(POS), F.lit("user").alias("role"),
                         F.lit(V.CONTINUE_TEXT).alias("text"),
                         F.lit(None).cast(df.schema["tool_calls"].dataType).alias("tool_calls"),
                         F.lit(None).cast("string").alias("tool_call_id"), F.lit(1).alias("__part"))
    out = alone.unionByName(rows).unionByName(filler)
    out = running(out, [KEY], order, slot, sums={"__new": _one()})
    return out.withColumn(POS, F.col("__new") - 1).drop("__new", "__part")


def _first(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Smallest non-null value of the session on every row of it."""
    firsts = df.groupBy(KEY).agg(F.min(value).alias(name)).withColumnRenamed(KEY, "__fk")
    return df.join(firsts, F.col(KEY) == F.col("__fk")).drop("__fk")


def augment(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """Puts the notes (session_id, context_note, continuity_note) into the first system
    message, or into a new one in front."""
    n = notes.select(F.col(KEY).alias("__nk"), "context_note", "continuity_note")
    sys_pos = messages.where(F.col("role") == "system").groupBy(KEY).agg(F.min(POS).alias("__sp"))
    side = n.join(sys_pos.withColumnRenamed(KEY, "__sk"), F.col("__nk") == F.col("__sk"), "left").drop("__sk")
    ctx = F.when(F.col("context_note").isNotNull(), F.concat(F.lit("\n\n"), F.col("context_note"))).otherwise("")
    cont = F.coalesce("continuity_note", F.lit(""))
    d = messages.join(side, F.col(KEY) == F.col("__nk"), "left")
    hit = F.col("role").eqNullSafe("system") & F.col("__sp").eqNullSafe(F.col(POS))
    d = d.withColumn("text", F.when(hit, F.concat(F.coalesce("text", F.lit("")), ctx, cont)).otherwise(F.col("text"))) \
        .select(*messages.columns)
    has_note = F.col("context_note").isNotNull() | F.col("continuity_note").isNotNull()
    fresh = side.where(F.col("__sp").isNull() & has_note).select(
        F.col("__nk").alias(KEY), F.lit(-1).cast("long").alias(POS), F.lit("system").alias("role"),
        F.when(F.col("context_note").isNotNull(), F.concat("context_note", cont)).otherwise(T.strip(cont)).alias("text"),
        F.lit(None).cast(messages.schema["tool_calls"].dataType).alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"))
    return d.unionByName(fresh)

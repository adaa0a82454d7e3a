"""Prompt feature vectors as one narrow expression tree per variant.

Each function takes a DataFrame with a text column and returns it with feature
columns added. Tokens and the lower-cased text are projected once, as columns of
an earlier Project, so that Catalyst evaluates them once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierflow import vocab as V
from tierflow.functions.num import even
from tierflow.functions import text as T

CODE = (rf"```|`[^`]+`|def\s+{T.WORD}|const\s+{T.WORD}|function\s+{T.WORD}|import\s+")
SAMPLE_CODE = (rf"```|`[^`]+`|def\s+{T.WORD}|const\s+{T.WORD}|function\s+{T.WORD}|"
               rf"class\s+{T.WORD}|import\s+[\p{{L}}\p{{N}}_.]")
FEEDBACK_CODE = rf"```|`[^`]+`|def\s+{T.WORD}|const\s+{T.WORD}|function\s+{T.WORD}"
STEPS = r"first|then|next|finally|step\s*[0-9]"
NEEDS_CONTEXT = r"the file|this project|my code|our system|given that|consider"


def _tokens(df: DataFrame, text: str) -> DataFrame:
    return (df.withColumn("__lower", F.lower(F.col(text)))
            .withColumn("__words", T.word_tokens(F.col("__lower"))))


def _counts(df: DataFrame, tech, vague=None) -> DataFrame:
    out = (df.withColumn("__wc", F.size("__words"))
           .withColumn("__chars", F.length(F.array_join("__words", "")))
           .withColumn("__tech", T.matches(F.col("__words"), tech)))
    return out.withColumn("__vague", T.matches(F.col("__words"), vague)) if vague else out


def _ratio(n: Column) -> Column:
    return n / F.greatest(F.col("__wc"), F.lit(1))


def _finish(df: DataFrame, columns: list[str], features: list[Column]) -> DataFrame:
    return df.select(*columns, *features)


def prompt_features(df: DataFrame, text: str = "text", rounded: bool = True) -> DataFrame:
    """15 features. ``rounded`` keeps three digits of the ratios."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = _counts(_tokens(df, text), V.TECH_WORDS, V.VAGUE_WORDS)
    d = (d.withColumn("__code", t.rlike(CODE)).withColumn("__q", t.contains("?"))
         .withColumn("__imp", T.starts_with_any(low, V.IMPERATIVES)))
    keep = (lambda c: even(c, 3)) if rounded else (lambda c: c)
    active = (F.col("__code").cast("int") + F.col("__q").cast("int") + F.col("__imp").cast("int")
              + (F.col("__tech") >= 3).cast("int"))
    return _finish(d, cols, [
        F.col("__wc").cast("double").alias("word_count"),
        T.sentence_count(t).cast("double").alias("sentence_count"),
        keep(_ratio(F.col("__chars"))).alias("avg_word_length"),
        T.flag(F.col("__code")).alias("has_code"),
        T.flag(F.col("__q")).alias("has_question"),
        T.flag(F.col("__imp")).alias("has_imperative"),
        F.col("__tech").cast("double").alias("technical_terms"),
        T.flag(F.col("__q") & (F.col("__tech") > 0)).alias("question_technical"),
        T.flag(T.any_of(low, V.ARCH_PHRASES)).alias("architecture"),
        T.flag(T.any_of(low, V.DESIGN_PHRASES)).alias("technical_design"),
        T.flag(low.rlike(STEPS)).alias("multi_step"),
        T.flag(low.rlike(NEEDS_CONTEXT)).alias("requires_context"),
        keep(_ratio(F.col("__tech"))).alias("domain_specificity"),
        keep(_ratio(F.col("__vague"))).alias("ambiguity_score"),
        T.flag(active >= 4).alias("four_plus"),
    ])


PROMPT_FEATURES = ["word_count", "sentence_count", "avg_word_length", "has_code", "has_question",
                   "has_imperative", "technical_terms", "question_technical", "architecture",
                   "technical_design", "multi_step", "requires_context", "domain_specificity",
                   "ambiguity_score", "four_plus"]


def sample_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Dataset-factory features, with a guess at the code language."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = _counts(_tokens(df, text), V.SAMPLE_TECH_WORDS, V.SAMPLE_VAGUE_WORDS)
    word = T.WORD
    # (?U) is avoided: a boundary is "no word character before"
    edge = rf"(?<!{word})"
    steps = rf"first|then|next|after that|finally|step\s*[0-9]|{edge}and also(?!{word})|{edge}plus(?!{word})"
    language = (F.when(low.rlike(rf"{edge}def\s+{word}") | low.contains("python"), "python")
                .when(low.rlike(rf"{edge}(?:const|let|var)\s+{word}") | low.contains("typescript"),
                      "typescript")
                .when(low.rlike(rf"{edge}fn\s+{word}") | low.contains("rust"), "rust")
                .when(low.rlike(rf"{edge}func\s+{word}") | low.contains("golang"), "go")
                .when(low.rlike(rf"{edge}select(?!{word})[^\n]*{edge}from(?!{word})"), "sql")
                .otherwise("unknown"))
    return _finish(d, cols, [
        F.col("__wc").cast("double").alias("word_count"),
        T.sentence_count(t).cast("double").alias("sentence_count"),
        even(_ratio(F.col("__chars")), 2).alias("avg_word_length"),
        t.rlike(SAMPLE_CODE).alias("has_code"),
        t.contains("?").alias("has_question"),
        T.starts_with_any(low, V.SAMPLE_IMPERATIVES).alias("has_imperative"),
        F.col("__tech").cast("double").alias("technical_terms"),
        (t.contains("?") & (F.col("__tech") > 0)).alias("question_technical"),
        T.any_of(low, V.SAMPLE_ARCH_PHRASES).alias("architecture"),
        T.any_of(low, V.SAMPLE_DESIGN_PHRASES).alias("technical_design"),
        low.rlike(steps).alias("multi_step"),
        low.rlike("the file|this project|my code|our system|the config|the database")
        .alias("requires_context"),
        language.alias("code_language"),
        even(_ratio(F.col("__tech")), 3).alias("domain_specificity"),
        even(_ratio(F.col("__vague")), 3).alias("ambiguity_score"),
    ])


def feedback_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Features stored with a routing-feedback row."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = _counts(_tokens(df, text), V.FEEDBACK_TECH_WORDS)
    return _finish(d, cols, [
        F.col("__wc").cast("double").alias("word_count"),
        T.sentence_count(t).cast("double").alias("sentence_count"),
        even(_ratio(F.col("__chars")), 2).alias("avg_word_length"),
        t.rlike(FEEDBACK_CODE).alias("has_code"),
        t.contains("?").alias("has_question"),
        T.starts_with_any(low, V.FEEDBACK_IMPERATIVES).alias("has_imperative"),
        F.col("__tech").cast("double").alias("technical_terms"),
        (t.contains("?") & (F.col("__tech") > 0)).alias("question_technical"),
        T.any_of(low, V.FEEDBACK_ARCH_PHRASES).alias("architecture"),
        T.any_of(low, V.FEEDBACK_DESIGN_PHRASES).alias("technical_design"),
        low.rlike(r"first|then|next|after that|finally|step\s*[0-9]").alias("multi_step"),
        low.rlike("the file|this project|my code|our system").alias("requires_context"),
        even(_ratio(F.col("__tech")), 3).alias("domain_specificity"),
        F.lit(0.1).alias("ambiguity_score"),
    ])


def generator_features(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Features stored with generated prompts; ambiguity is a constant of the label,
    so never fit a model on it."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = _counts(_tokens(df, text), V.GENERATOR_TECH_WORDS)
    d = d.withColumn("__ask", F.arrays_overlap(
        "__words", F.array(*[F.lit(w) for w in V.GENERATOR_INTERROGATIVES])))
    language = F.lit("unknown")
    for name, marks in reversed(V.GENERATOR_LANGUAGE_MARKERS):
        language = F.when(T.any_of(low, marks), name).otherwise(language)
    return _finish(d, cols, [
        F.col("__wc").cast("double").alias("word_count"),
        T.sentence_count(t).cast("double").alias("sentence_count"),
        even(_ratio(F.col("__chars")), 2).alias("avg_word_length"),
        T.any_of(t, V.GENERATOR_CODE_MARKERS).alias("has_code"),
        (t.contains("?") | F.col("__ask")).alias("has_question"),
        T.starts_with_any(low, V.GENERATOR_IMPERATIVES).alias("has_imperative"),
        F.col("__tech").cast("double").alias("technical_terms"),
        (F.col("__ask") & (F.col("__tech") > 0)).alias("question_technical"),
        language.alias("code_language"),
        even(_ratio(F.col("__tech")), 3).alias("domain_specificity"),
        F.when(F.col(label) == "trivial", 0.1).otherwise(0.2).alias("ambiguity_score"),
    ])


SIGNALS = ["has_question", "has_code", "has_imperative", "has_arithmetic", "has_sequential",
           "has_constraint", "has_context", "has_architecture", "has_design"]


def _signals(t: Column, low: Column) -> dict[str, Column]:
    return {
        "has_question": t.contains("?"),
        "has_code": T.any_of(low, V.SIGNAL_CODE),
        "has_imperative": low.rlike("^" + T.alternatives(V.SIGNAL_IMPERATIVES) + " "),
        "has_arithmetic": t.rlike(r"[0-9]\s*[+\-*/=]"),
        "has_sequential": T.any_of(low, V.SIGNAL_SEQUENCE),
        "has_constraint": T.any_of(low, V.SIGNAL_CONSTRAINT),
        "has_context": T.any_of(low, V.SIGNAL_CONTEXT),
        "has_architecture": T.any_of(low, V.SIGNAL_ARCHITECTURE),
        "has_design": T.any_of(low, V.SIGNAL_DESIGN),
    }


GATEWAY_FEATURES = SIGNALS + [
    "sentence_count", "avg_word_length", "question_technical", "technical_design",
    "technical_terms", "multi_step", "has_negation", "entity_count", "code_block_size",
    "domain_finance", "domain_legal", "domain_medical", "domain_engineering",
    "temporal_references", "output_format_spec", "prior_context_needed", "novelty_score",
    "multi_domain", "user_expertise_level"]


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def gateway_features(df: DataFrame, text: str = "text") -> DataFrame:
    """28 gateway features, plus ``ws_words``, the white-space word count."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    b, e = T.ASCII_START, T.ASCII_END
    d = (df.withColumn("__lower", F.lower(t))
         .withColumn("__words", T.space_tokens(F.col("__lower")))
         .withColumn("__wc", F.size("__words"))
         .withColumn("__tech", T.matches(F.col("__words"), V.TECH_WORDS))
         .withColumn("__blocks", F.regexp_extract_all(t, F.lit(r"(?s)```.*?```"), F.lit(0))))
    signals = _signals(t, low)
    for name, cond in signals.items():
        d = d.withColumn(name, T.flag(cond))
    for name, words in V.DOMAIN_WORDS.items():
        d = d.withColumn(f"domain_{name}", T.flag(T.any_of(low, words)))
    domains = [F.col(f"domain_{n}") for n in V.DOMAIN_WORDS]
    expert = F.size(F.filter("__words", lambda w: (
        (F.length(w) > 10) & w.isin(V.TECH_WORDS))
        | w.rlike("^" + T.alternatives(V.EXPERT_WORDS) + e)))
    block_lines = F.size("__blocks") + (
        F.length(F.array_join("__blocks", ""))
        - F.length(F.replace(F.array_join("__blocks", ""), F.lit("\n"), F.lit(""))))
    entities = (_count(t, V.ENTITY_COMPANY) + _count(t, f"{b}[A-Z]{{2,}}{e}")
                + _count(t, V.ENTITY_MONEY) + _count(t, V.ENTITY_DATE))
    wc = F.greatest(F.col("__wc"), F.lit(1))
    features = {
        **{s: F.col(s) for s in SIGNALS},
        "sentence_count": T.sentence_count(t).cast("double"),
        "avg_word_length": F.length(F.array_join("__words", "")) / wc,
        "question_technical": T.flag(t.contains("?") & (F.col("__tech") > 0)),
        "technical_design": F.greatest(F.col("has_design"), F.col("has_architecture")),
        "technical_terms": F.col("__tech").cast("double"),
        "multi_step": T.flag(low.rlike(STEPS)),
        "has_negation": T.flag(low.rlike(b + T.alternatives(V.NEGATION_WORDS) + e)),
        "entity_count": entities.cast("double"),
        "code_block_size": block_lines.cast("double"),
        **{f"domain_{n}": F.col(f"domain_{n}") for n in V.DOMAIN_WORDS},
        "temporal_references": _count(t, f"(?i){b}(?:{V.TEMPORAL}){e}").cast("double"),
        "output_format_spec": T.flag(low.rlike(f"{b}(?:{V.OUTPUT_FORMAT}){e}")),
        "prior_context_needed": T.flag(low.rlike(f"{b}(?:{V.PRIOR_CONTEXT}){e}")),
        "novelty_score": F.size(F.array_distinct("__words")) / wc,
        "multi_domain": T.flag(sum(domains[1:], domains[0]) >= 2),
        "user_expertise_level": F.when(expert >= 3, 2.0).when(expert >= 1, 1.0).otherwise(0.0),
    }
    return d.select(*cols, F.col("__wc").cast("double").alias("ws_words"),
                    *[F.coalesce(F.when(F.col("__wc") > 0, c), F.lit(0.0)).alias(n)
                      for n, c in features.items()])


def cascade_features(df: DataFrame, text: str = "text", variant: str = "voter") -> DataFrame:
    """Normalised 15 features. ``voter`` splits on white space and has short lists;
    ``retrain`` uses word tokens and the prompt-feature lists."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    trimmed = T.strip(low)
    d = df.withColumn("__lower", F.lower(t))
    if variant == "voter":
        d = d.withColumn("__words", T.space_tokens(low))
        code = t.rlike("def |function |class |import |const |let |var ")
        arch = t.rlike("architecture|system design|microservice|distributed")
        design = t.rlike("implementation|deployment|pipeline|schema")
        imperative = trimmed.rlike("^(?:write|create|build|implement|generate|fix|debug|analyze)")
        tech = ["api", "http", "rest", "docker", "kubernetes", "database", "algorithm",
                "security", "async", "await", "error", "type"]
        domain = low.rlike("finance|legal|medical|engineering|compliance|gdpr|hipaa|wacc|ebitda")
        vague = trimmed.rlike("^(?:help|what|how|why|do|can|is|are)")
    else:
        d = d.withColumn("__words", T.word_tokens(low))
        code = t.rlike(CODE)
        arch = T.any_of(low, V.ARCH_PHRASES)
        design = T.any_of(low, V.DESIGN_PHRASES)
        imperative = T.starts_with_any(low, V.IMPERATIVES)
        tech = V.TECH_WORDS
        domain = low.rlike("finance|legal|medical|engineering|compliance|gdpr|hipaa|wacc")
        vague = trimmed.rlike(rf"^(?:help|what|how|why|do|can|is|are)(?!{T.WORD})")
    d = (d.withColumn("__wc", F.size("__words"))
         .withColumn("__tech", T.matches(F.col("__words"), tech))
         .withColumn("__sc", T.sentence_count(t)))
    return _finish(d, cols, [
        (F.col("__sc") / 10.0).alias("sentence_count"),
        (_ratio(F.length(F.array_join("__words", ""))) / 10.0).alias("avg_word_length"),
        T.flag(t.contains("?")).alias("has_question"),
        T.flag(t.contains("?") & (F.col("__tech") > 0)).alias("question_technical"),
        T.flag(design).alias("technical_design"), T.flag(code).alias("code"),
        T.flag(arch).alias("architecture"), (F.col("__wc") / 100.0).alias("word_count"),
        T.flag(F.col("__sc") > 4).alias("four_plus"),
        T.flag(imperative).alias("has_imperative"),
        (F.col("__tech") / 5.0).alias("technical_terms"),
        T.flag(low.rlike(STEPS)).alias("multi_step"),
        T.flag(low.rlike(NEEDS_CONTEXT)).alias("requires_context"),
        T.flag(domain).alias("domain_specificity"), T.flag(vague).alias("ambiguity_score"),
    ])


def signal_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Nine-signal count, context flag, system-word count and white-space word count."""
    cols = df.columns
    t, low = F.col(text), F.col("__lower")
    d = (df.withColumn("__lower", F.lower(t))
         .withColumn("__wc", T.space_token_count(t)))
    conds = [c.cast("int") for c in _signals(t, low).values()]
    live = F.col("__wc") > 0
    return d.select(
        *cols, F.col("__wc").cast("long").alias("ws_words"),
        F.when(live, sum(conds[1:], conds[0])).otherwise(0).cast("long").alias("signals"),
        (live & T.any_of(low, V.SIGNAL_CONTEXT)).alias("has_context"),
        F.when(live, T.count_of(low, V.SYSTEM_WORDS)).otherwise(0).cast("long")
        .alias("system_words"))


def to_vector(code_slot: str = "zero") -> Column:
    """Ordered 15-vector of ``prompt_features``. The slot named ``code`` is 0 by
    default, which is what the shipped weights were fitted on; ``flag`` fills it."""
    code = F.lit(0.0) if code_slot == "zero" else F.col("has_code")
    return F.array(*[code if n == "code" else F.col(n).cast("double") for n in V.FEATURE_NAMES])


def optimiser_vector() -> Column:
    """Vector of ``sample_features`` for the weight fit; ``four_plus`` is a 0-4 count there."""
    four = (F.col("has_code").cast("double") + F.col("has_question").cast("double")
            + F.col("has_imperative").cast("double") + (F.col("technical_terms") > 0).cast("double"))
    names = {"code": F.col("has_code"), "four_plus": four}
    return F.array(*[(names[n] if n in names else F.col(n)).cast("double") for n in V.FEATURE_NAMES])

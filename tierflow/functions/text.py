"""Text expressions. All are built-in Spark functions: no Python in the row path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tierflow import vocab as V

# Word characters and white space are spelled out, because engines differ in what
# \w, \s and \b cover.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same class turned round. Java tests a negated class ten times as slowly as these ranges.
NOT_SPACE = (r"\x21-\x9F\x00-\x08\x0E-\x1F\xA1-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}"
             r"\x{2060}-\x{2FFF}\x{3001}-\x{FEFE}\x{FF00}-\x{10FFFF}")
ASCII_START, ASCII_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def any_of(col: Column, needles) -> Column:
    """True when any literal occurs in the column."""
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def count_of(col: Column, needles) -> Column:
    """How many of the literals occur at least once."""
    return reduce(lambda a, b: a + b, [col.contains(n).cast("int") for n in needles])


def alternatives(words) -> str:
    """Words as a regex group; the words hold no regex metacharacters but '.', '/' and '+'."""
    return "(?:" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words) + ")"


def starts_with_any(col: Column, words) -> Column:
    return col.rlike("^" + alternatives(words))


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_tokens(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(WORD + "+"), F.lit(0))


def space_tokens(col: Column) -> Column:
    return F.filter(F.split(col, f"[{SPACE}]+"), lambda w: w != "")


def space_token_count(col: Column) -> Column:
    """How many ``space_tokens``."""
    return F.regexp_count(col, F.lit(f"[{NOT_SPACE}]+"))


def sentence_count(text: Column) -> Column:
    """Stretches between . ! ? that hold something besides white space."""
    return F.regexp_count(text, F.lit(rf"[^.!?{SPACE}][^.!?]*"))


def matches(words: Column, vocabulary) -> Column:
    """How many tokens belong to the vocabulary, repeats counted."""
    return F.size(F.filter(words, lambda w: w.isin(list(vocabulary))))


def flag(cond: Column) -> Column:
    return cond.cast("double")


def keywords(text: Column, distinct: bool = True, stop_prefixes=V.STOP_PREFIXES,
             n: int = 10) -> Column:
    """First n longer words that do not begin with a stop prefix."""
    words = F.filter(F.split(F.lower(text), f"[{SPACE}]+"),
                     lambda w: (F.length(w) > 4) & ~w.rlike("^" + alternatives(stop_prefixes)))
    return F.slice(F.array_distinct(words) if distinct else words, 1, n)


def prompt_hash(text: Column, prefix: str = "") -> Column:
    digest = F.substring(F.sha2(text, 256), 1, 16)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def sample_id(source: Column, index: Column, text: Column) -> Column:
    """Stable id from the source, the row number and the head of the text."""
    digest = F.md5(F.concat_ws(":", source, index.cast("string"), F.substring(text, 1, 100)))
    return F.concat(F.lit("gpd_"), F.substring(source, 1, 3), F.lit("_"), F.substring(digest, 1, 12))


def file_sample_id(path: Column, index: Column) -> Column:
    return F.format_string("ws_%s_%04d", F.substring(F.md5(path), 1, 8), index)


def safe_summary(text: Column, length: int = 500) -> Column:
    masked = F.regexp_replace(text, r"(?i)(api_key|password|token|secret|key)[=:]\s*\S+",
                              "$1=***REDACTED***")
    return F.substring(masked, 1, length)


def est_tokens(text: Column, calls_length: Column | None = None) -> Column:
    """A quarter of the characters, plus 10 per message."""
    size = F.length(F.coalesce(text, F.lit("")))
    if calls_length is not None:
        size = size + calls_length
    return F.ceil(size / F.lit(4.0)).cast("long") + 10


def topic_tags(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(any_of(lower, words), F.lit(name))
                                     for name, words in V.TOPIC_GROUPS]))


def semantic_importance(tags: Column) -> Column:
    return F.least(F.lit(1.0), F.size(tags) / F.lit(4.0))


DECISION_CAPTURES = [
    r"(?i)(?:decision|conclusion|therefore|resolved|agreed|final)[:\s]*([^\n]+)",
    r"(?i)(?:the answer is|key point|important|note that)[:\s]*([^\n]+)",
]


def key_decisions(text: Column) -> Column:
    """Rest of the line after each decision or key-point marker, 150 characters each."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DECISION_CAPTURES]
    return F.transform(F.concat(*found), lambda s: F.substring(strip(s), 1, 150))


VOTE_REPLY = (r"(?i)^(✅|yes|correct|👍|❌|no|wrong|nah)[" + SPACE + r"]*"
              r"(trivial|light|moderate|heavy|intensive|extreme)?$")


def parse_vote_reply(text: Column) -> tuple[Column, Column]:
    """(agreed, correct_tier); agreed is null when the text is no vote."""
    trimmed = strip(text)
    mark = F.lower(F.regexp_extract(trimmed, VOTE_REPLY, 1))
    tier = F.nullif(F.lower(F.regexp_extract(trimmed, VOTE_REPLY, 2)), F.lit(""))
    agreed = F.when(mark == "", F.lit(None)).otherwise(
        mark.isin("✅", "yes", "correct", "👍") & tier.isNull())
    return agreed, F.when(mark != "", tier)


def block_text(blocks: Column) -> Column:
    """Joined text of typed content blocks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"),
                                    lambda b: b["text"]), " ")


def strip_thinking(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~b["type"].isin("thinking", "reasoning_content"))


def continuity_note(decisions: Column, tier: Column, model: Column) -> Column:
    last3 = F.when(F.size(decisions) > 3, F.slice(decisions, -3, 3)).otherwise(decisions)
    bullets = F.array_join(F.transform(last3, lambda d: F.concat(F.lit("- "), d)), "\n")
    return F.when(F.size(decisions) > 0, F.concat(
        F.lit("\n\nContinuity from previous turn ("), tier, F.lit("→"), model, F.lit("):\n"), bullets))


CONTEXT_HEADER = "Relevant prior context (auto-retrieved):\n"


def context_note(role: Column, summary: Column) -> Column:
    return F.concat(F.lit("[Retrieved context from "), role, F.lit(": "), summary, F.lit("]"))


def chunk_text(df, text: str = "text", suffix: str | None = None, kind: str | None = None,
               window: int = 4000, overlap: int = 500, minimum: int = 0):
    """One row per chunk: code at definitions, markdown at headings, else fixed windows.

    ``kind`` fixes the rule for all rows; ``suffix`` names a column with the file suffix.
    Chunks of ``minimum`` characters or fewer, and blank ones, go (the reference has 50); a text without another keeps all its windows.
    """
    t = F.col(text)
    code = F.split(t, r"(?=(?:def |async def |function |class |fn |func |"
                      r"const\s+[\p{L}\p{N}_]+\s*=\s*(?:async\s+)?\())")
    markdown = F.split(t, r"(?m)^#{1,3}\s+")
    last = F.greatest(F.floor((F.length(t) - 1) / F.lit(window - overlap)), F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last.cast("int")),
                          lambda i: F.substring(t, i * (window - overlap) + 1, F.lit(window)))
    by_kind = {"code": code, "markdown": markdown, "window": windows}
    if kind:
        parts = by_kind[kind]
    else:
        s = F.col(suffix)
        parts = (F.when(s.isin(V.CODE_SUFFIXES), code)
                 .when(s.isin(V.MARKDOWN_SUFFIXES), markdown).otherwise(windows))
    kept = F.transform(F.filter(parts, lambda p: (F.length(p) > minimum) & (strip(p) != "")),
                       lambda p: strip(p))
    chunks = df.withColumn("__chunks", kept).withColumn(
        "__chunks", F.when(F.size("__chunks") > 0, F.col("__chunks"))
        .otherwise(windows))
    names = [F.col(c) for c in df.columns]
    return chunks.select(*names, F.posexplode("__chunks").alias("chunk_pos", "chunk"))

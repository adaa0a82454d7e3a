"""Redaction: 35 ordered rules, each a regex count and, where it hits, a replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierflow.functions.text import SPACE, WORD

START, END = f"(?<!{WORD})", f"(?!{WORD})"
# a boundary whose neighbours may be either kind of character
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# --- fixed values: (category, literal that must occur or None, pattern, replacement) ---
NAMES = ("Ana|Bruno|Carla|Diego|Eduarda|Felipe|Giovana|Henrique|Iara|Joao|Karina|Lucas|Marina|"
         "Nicolas|Olivia|Paulo|Rafaela|Sofia|Tiago|Vitoria|Pedro|Maria|Jose|João|Antônio|"
         "Francisco|Carlos|Luiz|Marcos|Fernando")
RULES = [
    ("pii", "@", r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL_REDACTED]"),
    ("pii", "+55", r"\+55\s*\d{2}\s*9?\d{4}[-\s]?\d{4}", "[PHONE_REDACTED]"),
    ("pii", "+", r"\+\d{1,3}[\s.-]?\d{2,4}[\s.-]?\d{3,5}[\s.-]?\d{4}", "[PHONE_REDACTED]"),
    ("pii", "-", START + r"\d{3}\.\d{3}\.\d{3}-\d{2}" + END, "[CPF_REDACTED]"),
    ("pii", "/", START + r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}" + END, "[CNPJ_REDACTED]"),
    ("pii", ".", START + r"(?:\d{1,3}\.){3}\d{1,3}" + END, "[IP_REDACTED]"),
    ("pii", None, START + r"(?:\d{4}[\s-]?){3}\d{4}" + END, "[CC_REDACTED]"),
    ("pii", "-", START + r"\d{3,4}-\d" + END, "[BANK_ACCOUNT_REDACTED]"),
    ("pii", "=", EDGE + rf"[pix_key|]=[^{SPACE}]+", "[PIX_KEY_REDACTED]"),
    ("pii", None, START + r"(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])" + END,
     "[DATE_REDACTED]"),
    ("secret", None, rf"(?i)(?:api[_-]?key|apikey|api[_-]?token)\s*[=:]\s*[^{SPACE}]+", "[API_KEY_REDACTED]"),
    ("secret", None, r"(?i)(?:bearer|token|auth)\s+[A-Za-z0-9_\-.]{10,}", "[TOKEN_REDACTED]"),
    ("secret", "sk-", r"sk-[A-Za-z0-9_-]{20,}", "[SECRET_KEY_REDACTED]"),
    ("secret", "-----BEGIN",
     r"(?s)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----.*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
     "[PRIVATE_KEY_REDACTED]"),
    ("secret", None, rf"(?i)(?:password|passwd|pwd)\s*[=:]\s*[^{SPACE}]+", "[PASSWORD_REDACTED]"),
    ("secret", None, r"(?:refresh_token|rt_)[A-Za-z0-9_-]{10,}", "[REFRESH_TOKEN_REDACTED]"),
    ("secret", "sess", r"(?:session_id|sess_)[A-Za-z0-9_-]{10,}", "[SESSION_ID_REDACTED]"),
    ("secret", "eyJ", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT_REDACTED]"),
    ("secret", None, r"(?:secret|key|token|hash)\s*[=:]\s*[0-9a-fA-F]{32,}", "[HEX_SECRET_REDACTED]"),
    ("secret", "AKIA", r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]"),
    ("context", None, "(?iu)" + START + f"(?:{NAMES})" + END, "[PERSON]"),
    ("context", None, START + r"[A-Z][a-z]+\s+(?:Corp|Inc|Ltd|LLC|GmbH|SA|Ltda|Tech|Labs|Systems|"
     r"Services|Group|Holdings|Solutions)" + END, "[ORGANIZATION]"),
    ("context", "/root/", r"/root/\.openclaw/workspace/[a-zA-Z0-9_-]+/", "[PROJECT_PATH]/"),
    ("context", "/home/", r"/home/[a-zA-Z0-9_-]+/", "/home/[USER]/"),
    ("context", ".internal", EDGE + r"[a-zA-Z0-9-]+\.internal" + END, "[INTERNAL_HOST]"),
    ("context", ".", EDGE + r"[a-zA-Z0-9-]+\.(?:corp|local|internal|dev\.local|staging)" + END,
     "[INTERNAL_DOMAIN]"),
    ("context", None, rf"(?:treasury|ops-wallet|payments-admin|core-banking)[\s:-]?{WORD}*",
     "[FINANCIAL_SERVICE]"),
    ("context", None, START + r"[0-9a-f]{7,40}" + END, "[COMMIT_HASH]"),
    ("generalized", None, START + r"\d{5,}" + END, None),  # [NUMBER_n], n = digits
    ("generalized", "http", r"https?://[a-zA-Z0-9.-]+\.[a-z]{2,}(?:/[^" + SPACE + r"]*)?", "[URL]"),
    ("generalized", "/", r"/(?:Users|home|var|tmp|opt|etc)/[a-zA-Z0-9_/.-]+", "[FILE_PATH]"),
    ("generalized", "v", r"v(\d+)\.(\d+)\.(\d+)", "v$1.[MINOR].[PATCH]"),
    ("generalized", "%", START + rf"\d{{1,2}}\.\d+%(?={WORD})", "[PERCENTAGE]"),
    ("generalized", "US", r"USD?\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?", "[AMOUNT]"),
    ("generalized", ":", r"\d{2}:\d{2}:\d{2}", "[TIME]"),
]
CATEGORIES = ["pii", "secret", "context", "generalized"]


def _number_replace(text: Column, pattern: str) -> Column:
    """The digits' count stands in for the digits, whatever their number."""
    parts = F.split(text, pattern, -1)
    marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda m: F.concat(F.lit("[NUMBER_"), F.length(m).cast("string"), F.lit("]")))
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def _replace(text: Column, pattern: str, replacement: str | None) -> Column:
    if replacement is None:
        return _number_replace(text, pattern)
    return F.regexp_replace(text, pattern, replacement)


def redact_text(text: Column) -> Column:
    """All rules as one expression, without counts."""
    for _, _, pattern, replacement in RULES:
        text = _replace(text, pattern, replacement)
    return text


def redact(df: DataFrame, text: str = "text", rules=RULES, each: bool = False) -> DataFrame:
    """Redacted text and the hits per category (``n_pii`` ...). One Project per rule, so
    that each rule sees its predecessor's text once; a literal that must occur spares most
    rows the regex. ``each`` also keeps the hits per rule as ``r_1`` ... ."""
    cols = [c for c in df.columns if c != text]
    d = df.select(*cols, F.col(text).alias("__t0"))
    for i, (_, literal, pattern, replacement) in enumerate(rules, 1):
        prev = F.col(f"__t{i - 1}")
        hits = F.regexp_count(prev, F.lit(pattern))
        if literal:
            hits = F.when(prev.contains(literal), hits).otherwise(0)
        counts = [F.col(f"r_{j}") for j in range(1, i)]
        d = d.select(*cols, *counts, prev, hits.alias(f"r_{i}"))
        d = d.select(*cols, *counts, f"r_{i}", F.when(F.col(f"r_{i}") > 0, _replace(prev, pattern, replacement))
                     .otherwise(prev).alias(f"__t{i}"))
    last = F.col(f"__t{len(rules)}").alias(text)
    per_rule = [F.coalesce(F.col(f"r_{i}"), F.lit(0)).cast("long") for i in range(1, len(rules) + 1)]
    sums = [sum([c for c, r in zip(per_rule, rules) if r[0] == cat], F.lit(0).cast("long")).alias(f"n_{cat}")
            for cat in CATEGORIES]
    keep = [c.alias(f"r_{i}") for i, c in enumerate(per_rule, 1)] if each else []
    return d.select(*cols, last, *sums, *keep)


def redact_dataset(df: DataFrame, field: str = "text", max_n: int | None = None, at=None,
                   order: str = "id") -> DataFrame:
    """Text field with counts, values of the context map longer than 10 characters, and the
    redaction marks. ``max_n`` takes the first rows only."""
    from tierflow.operators.dataset import first_n
    d = df if max_n is None else first_n(df, max_n, order)
    d = redact(d, field)
    if "context" in df.columns:
        d = d.withColumn("context", F.transform_values(
            "context", lambda k, v: F.when(F.length(v) > 10, redact_text(v)).otherwise(v)))
    return d.withColumn("anonymized", F.lit(True)).withColumn(
        "anonymized_at", F.lit(at).cast("timestamp") if at else F.current_timestamp())


def redaction_report(redacted: DataFrame) -> DataFrame:
    """Totals per category over a redacted dataset."""
    sums = [F.sum(f"n_{c}").alias(c) for c in CATEGORIES]
    return redacted.agg(F.count(F.lit(1)).alias("samples"), *sums).withColumn(
        "total", sum([F.col(c) for c in CATEGORIES[1:]], F.col(CATEGORIES[0])))

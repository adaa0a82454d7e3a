"""Views of the given tables in the shapes the operators need: prompts, interactions,
messages, votes, attempts and responses. Every row and the whole text is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Opening phrases, so that prose also reaches the code, question, design and redaction branches.
PHRASES = [
    "hello", "What is an API?", "Write a function: `def add(a, b)` and explain it.",
    "Design a distributed event-driven microservice architecture with load balancer, kafka, "
    "redis, docker and kubernetes",
    "First read the file, then fix this stuff. Finally deploy.",
    "Given that our system must handle 10 + 5 users, consider the migration strategy",
    "Do not use XML; format as json by tomorrow for Acme Corp at $5M",
    "GDPR compliance and balance sheet forecast within 3 days",
    "```\nimport os\nx = 1\n``` why does this async function error?",
    "Decision: we agreed on a monolith. Note that the password=hunter2 must rotate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores when it comes as fewer files than
    cores: a file may be a single row group, which one task would read and tokenise. With
    files enough, as on a cluster, nothing is shuffled."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *[k for k in (TEXT_KEYS[name], "turn") if k in df.columns])


def _phrase(key):
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (key % len(PHRASES) + 1).cast("int"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): all documents and all user turns, each behind an opening phrase."""
    docs = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", _phrase(F.col("doc_id")), "text").alias("text"))
    turns = text_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (F.lit(1000000000000) + F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.concat_ws(" ", _phrase(F.col("conv_id") + F.col("turn")), "text").alias("text"))
    return docs.unionByName(turns)


def interactions_from(events: DataFrame) -> DataFrame:
    """Feedback and cost log rows out of events; works on static and streaming input."""
    return events.selectExpr(
        "event_id AS interaction_id", "ts",
        "concat('agent-', cast(user_id % 10 AS string)) AS agent_id",
        "(event_id * 7 + user_id) % 6 AS predicted_idx",
        """CASE WHEN event_id % 5 = 0 THEN NULL
                WHEN event_id % 3 = 0 THEN least(5, (event_id * 7 + user_id) % 6 + 1)
                WHEN event_id % 7 = 0 THEN greatest(0, (event_id * 7 + user_id) % 6 - 1)
                ELSE (event_id * 7 + user_id) % 6 END AS actual_idx""",
        "CASE WHEN event_type = 'error' THEN 0 ELSE cast(floor(value * 20) AS bigint) END AS tokens_in",
        "CASE WHEN event_type = 'error' THEN 0 ELSE cast(floor(value * 5) AS bigint) END AS tokens_out",
        "cast(floor(value * 100) AS bigint) AS latency_ms",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(event_id % 11 AS double) / 10 END AS adequacy",
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status",
        """CASE event_id % 6 WHEN 0 THEN 'openrouter/owl-alpha'
             WHEN 1 THEN 'openrouter/z-ai/glm-4.7-flash' WHEN 2 THEN 'qwen/qwen-plus'
             WHEN 3 THEN 'anthropic/claude-sonnet-4.6' WHEN 4 THEN 'anthropic/claude-opus-4.6'
             ELSE 'bailian/qwen3.5-plus' END AS routed_model""")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tierflow.functions.scoring import tier_at
    d = interactions_from(table(spark, sf_dir, "events"))
    return (d.withColumn("predicted_tier", tier_at(F.col("predicted_idx")))
            .withColumn("actual_tier", tier_at(F.col("actual_idx"))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, pos, role, text, tool_calls, tool_call_id): long sessions with tool rows."""
    return text_table(spark, sf_dir, "conversations").selectExpr(
        "cast(floor(conv_id / 20) AS bigint) AS session_id", "conv_id * 100 + turn AS pos",
        "CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 3 = 0 THEN 'tool' ELSE role END AS role",
        """concat(CASE conv_id % 5 WHEN 0 THEN 'The final decision: use kafka. '
                   WHEN 1 THEN 'error: timeout in the docker deployment. '
                   WHEN 2 THEN 'async function and database schema must change. ' ELSE '' END,
                  repeat(text, 5)) AS text""",
        """CASE WHEN role = 'assistant' AND turn % 4 = 1 AND conv_id % 3 = 0
                THEN array(named_struct('id', concat('tc_', cast(conv_id AS string), '_',
                                                     cast(turn AS string)))) END AS tool_calls""",
        """CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 3 = 0
                THEN concat('tc_', cast(conv_id AS string), '_', cast(turn - 1 AS string)) END
           AS tool_call_id""")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn with the assistant turn that follows it."""
    conv = text_table(spark, sf_dir, "conversations")
    u = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = conv.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"]).selectExpr(
        "conv_id * 100 + turn AS id", "prompt",
        "repeat(concat(reply, ' '), cast(1 + (conv_id * 7) % 40 AS int)) AS response",
        "(conv_id + turn) % 6 AS predicted_idx",
        "(conv_id * 37 + turn * 11) % 3000 AS tokens_out",
        "(conv_id * 977 + turn * 131) % 40000 AS latency_ms")


def vote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select(
        F.col("interaction_id").alias("request_id"), "agent_id", F.col("ts").alias("asked_at"),
        "predicted_tier")


def vote_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = interactions(spark, sf_dir)
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                               (F.col("interaction_id") % 600 + 1).cast("decimal(18,6)"))
    cycle = ["yes", "✅", "no", "wrong heavy", "correct light", "maybe later"]
    return d.select(
        F.col("interaction_id").alias("reply_id"), "agent_id", (F.col("ts") + delay).alias("replied_at"),
        F.element_at(F.array(*[F.lit(c) for c in cycle]),
                     (F.col("interaction_id") % 6 + 1).cast("int")).alias("reply_text"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call results per interaction and chain position, for five positions."""
    status = F.element_at(F.array(*[F.lit(s) for s in ["200", "429", "500", "400", "timeout"]]),
                          ((F.col("interaction_id") * 3 + F.col("pos") * 2) % 5 + 1).cast("int"))
    return (interactions(spark, sf_dir).select("interaction_id", "predicted_tier")
            .withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
            .withColumn("status", status))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval entries out of conversations: keywords of each assistant turn."""
    from tierflow.functions import text as T
    from tierflow.functions.scoring import tier_at
    conv = text_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("entry_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("created"),
        T.keywords(F.col("text")).alias("keywords"),
        T.topic_tags(F.col("text")).alias("tags"),
        tier_at((F.col("conv_id") + F.col("turn") * 5) % 6).alias("tier"),
        F.col("role").alias("original_role"),
        ((F.col("conv_id") + F.col("turn")) % 11 / 10.0).alias("adequacy"),
        F.substring("text", 1, 200).alias("summary"),
        F.length("text").cast("long").alias("original_tokens"),
        F.floor(F.length("text") / 3).cast("long").alias("compressed_tokens"))


def retrieval_queries(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    from tierflow.functions import text as T
    conv = text_table(spark, sf_dir, "conversations").where("role = 'user'")
    return conv.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
                       T.keywords(F.col("text"), distinct).alias("keywords"), "text")

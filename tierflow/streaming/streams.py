"""Streaming forms of the scoring and log operators. Every state is bounded by a watermark
or by a fixed number of rows per key."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tierflow.operators import routing as R
from tierflow.operators.feedback import match_votes
from tierflow.operators.scale import scratch_dir, staged

MATCHED = "reply_id bigint, agent_id string, request_id bigint, predicted_tier string, agreed boolean, correct_tier string"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """File stream over one of the given tables, which is a file or a folder of files."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}.parquet")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available into files and reads them back."""
    out = scratch_dir(stream.sparkSession)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start(f"{out}/data"))
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def score_stream(prompts: DataFrame) -> DataFrame:
    """Score and route; stateless."""
    return R.score_prompts(prompts)


def windowed_metrics(costs: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests, right tiers, tokens and cost per window and tier; rows later than the
    watermark are dropped."""
    judged = F.col("actual_tier").isNotNull()
    return (costs.withWatermark(ts, late).groupBy(F.window(ts, width), "predicted_tier").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(judged.cast("long")).alias("judged"),
        F.sum(F.coalesce((F.col("actual_tier") == F.col("predicted_tier")).cast("long"), F.lit(0))).alias("correct"),
        F.sum("cost_usd").alias("cost_usd"))
        .select(F.col("window.start").alias("start"), "predicted_tier", "requests", "judged", "correct", "cost_usd"))


def sessions(turns: DataFrame, idle: str = "1 hour", late: str = "10 minutes", ts: str = "ts",
             key: str = "agent_id") -> DataFrame:
    """Sessions that end after an idle hour: turns, last tier and model."""
    last = F.max_by(F.struct("predicted_tier", "routed_model"), F.struct(ts, "interaction_id"))
    return (turns.withWatermark(ts, late).groupBy(key, F.session_window(ts, idle)).agg(
        F.count(F.lit(1)).alias("turns"), last.alias("l"))
        .select(key, F.col("session_window.start").alias("start"), "turns",
                F.col("l.predicted_tier").alias("last_tier"), F.col("l.routed_model").alias("last_model")))


VOTE_EVENT = "agent_id string, t timestamp_ntz, kind int, id bigint, predicted_tier string, reply_text string"
_CLOCK = "batch bigint, requests timestamp_ntz, replies timestamp_ntz"


def vote_events(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (kind 0) and replies (kind 1) as one stream or table."""
    none, at = F.lit(None).cast("string"), lambda c: F.col(c).cast("timestamp_ntz").alias("t")
    asked = requests.select("agent_id", at("asked_at"), F.lit(0).alias("kind"), F.col("request_id").cast("long").alias("id"), "predicted_tier", none.alias("reply_text"))
    said = replies.select("agent_id", at("replied_at"), F.lit(1).alias("kind"), F.col("reply_id").cast("long").alias("id"), none.alias("predicted_tier"), "reply_text")
    return asked.unionByName(said)


class VoteMatcher:
    """Pairs every reply of a stream with the newest request of its agent that is still unanswered and young enough; an answered request is gone.

    The state between micro-batches is a table: the events at or after the watermark, and the requests before it that are open and may still be
    answered. A micro-batch decides, by the brackets of ``feedback.match_votes``, what lies before the new watermark, so rows may
    come in any order up to ``late_seconds``. The watermark is the earlier of the newest request and the newest reply, less ``late_seconds``; later
    rows are dropped, as are rows without a time. ``finish`` decides the rest once no more rows come. State and output of a micro-batch
    are written over when it is repeated; two state folders take turns, so the state holds no more than ``within_seconds + late_seconds`` of
    events. Ids are unique among requests and among replies.
    """

    def __init__(self, state: str, out: str, within_seconds: int = 300, late_seconds: int = 600):
        self.state, self.out, self.within, self.late = state, out, within_seconds, late_seconds

    def sink(self, events: DataFrame):
        return events.writeStream.foreachBatch(self.step)

    def matched(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{MATCHED}, batch bigint").parquet(self.out).drop("batch")

    def finish(self, spark: SparkSession) -> None:
        clocks = [c for c in (self._clock(spark, n) for n in (0, 1)) if c]
        if clocks:
            self.step(spark.createDataFrame([], VOTE_EVENT), max(c.batch for c in clocks) + 1, last=True)

    def _clock(self, spark: SparkSession, batch: int):
        try:
            return spark.read.schema(_CLOCK).parquet(f"{self.state}/clock{batch % 2}").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _watermark(self, clock):
        if clock is None or clock.requests is None or clock.replies is None:
            return None
        return min(clock.requests, clock.replies) - timedelta(seconds=self.late)

    def step(self, batch: DataFrame, number: int, last: bool = False) -> None:
        spark = batch.sparkSession
        before = self._clock(spark, number - 1) if number else None
        old = self._watermark(before)
        events = batch.where("t is not null" if old is None else F.col("t") >= F.lit(old).cast("timestamp_ntz"))
        if before is not None:
            events = events.unionByName(spark.read.schema(VOTE_EVENT).parquet(f"{self.state}/events{(number - 1) % 2}"))
        events = staged(events)
        newest = events.agg(*[F.max(F.when(F.col("kind") == k, F.col("t"))) for k in (0, 1)]).first()
        known = [max((x for x in pair if x is not None), default=None)
                 for pair in zip(newest, (before.requests, before.replies) if before else (None, None))]
        clock = Row(batch=number, requests=known[0], replies=known[1])
        mark = self._watermark(clock)
        due = F.lit(True) if last else F.lit(False) if mark is None else F.col("t") < F.lit(mark).cast("timestamp_ntz")
        ready, asked = events.where(due), F.col("kind") == 0
        requests = ready.where(asked).select("agent_id", F.col("t").alias("asked_at"), F.col("id").alias("request_id"), "predicted_tier")
        replies = ready.where(~asked).select("agent_id", F.col("t").alias("replied_at"), F.col("id").alias("reply_id"), "reply_text")
        out = f"{self.out}/batch={number}"
        if last or mark is not None:
            match_votes(replies, requests, self.within).write.mode("overwrite").parquet(out)
        else:
            spark.createDataFrame([], MATCHED).write.mode("overwrite").parquet(out)
        rest = events.where(~due)
        if mark is not None and not last:
            answered = spark.read.schema(MATCHED).parquet(out).select(F.col("request_id").alias("id"))
            young = F.col("t") > F.lit(mark - timedelta(seconds=self.within)).cast("timestamp_ntz")
            rest = rest.unionByName(ready.where(asked & young).join(answered, "id", "left_anti").select(*events.columns))
        rest.write.mode("overwrite").parquet(f"{self.state}/events{number % 2}")
        spark.createDataFrame([clock], _CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/clock{number % 2}")


def drop_replays(stream: DataFrame, key: str = "interaction_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _bias(up: list, down: list, low: list) -> float:
    n = len(up)
    if n < 5 or sum(up) + sum(down) < 3:
        return 0.0
    raw = 0.02 * sum(up) - 0.02 * sum(down) + (0.05 if sum(low) / n > 0.3 else 0.0)
    return max(-0.1, min(0.1, raw))


def rolling_bias(log: DataFrame, n: int = 50) -> DataFrame:
    """History bias of each row from the agent's n rows before it; the state is those n
    rows as three flag lists. Expects interaction_id, agent_id, ts, predicted_idx,
    actual_idx and adequacy."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, low = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values(["ts", "interaction_id"])
        out = []
        actual, predicted = rows["actual_idx"], rows["predicted_idx"]
        flags = zip((actual > predicted).astype(int), (actual < predicted).astype(int),
                    (rows["adequacy"].fillna(0.5) < 0.6).astype(int))
        for u, d, w in flags:
            out.append(_bias(up, down, low))
            up, down, low = (up + [int(u)])[-n:], (down + [int(d)])[-n:], (low + [int(w)])[-n:]
        state.update((up, down, low))
        yield pd.DataFrame({"interaction_id": rows["interaction_id"], "bias": out})

    return log.groupBy("agent_id").applyInPandasWithState(
        step, "interaction_id long, bias double", "up array<int>, down array<int>, low array<int>", "append",
        GroupStateTimeout.NoTimeout)


def last_decisions(turns: DataFrame, keep: int = 10, idle_ms: int = 3600000, late: str = "10 minutes") -> DataFrame:
    """Last decisions of each agent's running session, emitted when the session has been
    idle for an hour of event time. Expects agent_id, ts and decisions (array)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(start, kept):
            return pd.DataFrame({"agent_id": [key[0]], "start": [pd.Timestamp(start, unit="us")], "decisions": [kept]})
        if state.hasTimedOut:
            start, _, kept = state.get
            state.remove()
            yield row(start, list(kept))
            return
        start, last, kept = state.get if state.exists else (None, None, [])
        kept = list(kept)
        rows = pd.concat(list(batches)).sort_values("ts")
        for t, decisions in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["decisions"]):
            if start is not None and t - last > idle_ms * 1000:
                yield row(start, kept)
                start, kept = None, []
            start = int(t) if start is None else start
            last, kept = int(t), (kept + list(decisions))[-keep:]
        state.update((start, last, kept))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    return turns.withWatermark("ts", late).groupBy("agent_id").applyInPandasWithState(
        step, "agent_id string, start timestamp, decisions array<string>",
        "start long, last long, kept array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def index_sink(stream: DataFrame, path: str):
    """Appends retrieval entries to the index files; readers apply the TTL."""
    def append(batch: DataFrame, _):
        batch.write.mode("append").parquet(path)
    return stream.writeStream.foreachBatch(append)


def retrieve_sink(queries: DataFrame, index_path: str, out_path: str, k: int = 3, **options):
    """Looks every micro-batch of queries up in the index as it stands."""
    from tierflow.operators.retrieval import retrieve

    def look(batch: DataFrame, _):
        index = batch.sparkSession.read.parquet(index_path)
        retrieve(batch, index, k, **options).write.mode("append").parquet(out_path)
    return queries.writeStream.foreachBatch(look)

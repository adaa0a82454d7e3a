"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LAST = (1 << 63) - 1  # a null doc_id comes after every other
BUCKET_BYTES = 8 << 20

_MESSAGE = "b int, s int, round int, payload binary"
_MESSAGE_ARROW = pa.schema([("b", pa.int32()), ("s", pa.int32()), ("round", pa.int32()), ("payload", pa.binary())])


_held: dict = {}


def held(name: str, make):
    """What a worker keeps between tasks: of one operator at a time, so that stages that follow each other don't add up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def doc_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of every row, whatever else the table holds; a null text is empty."""
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids(column) -> np.ndarray:
    """doc_id column of an Arrow table as int64, nulls last."""
    return column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False) if column.num_chunks != 0 else np.zeros(0, np.int64)


def split_by(shard: np.ndarray, n: int):
    """(shard, positions) for each shard present, in order."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    return [(s, order[cut[s]:cut[s + 1]]) for s in np.unique(shard)]


def _messages(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _MESSAGE_ARROW.types)],
                    schema=_MESSAGE_ARROW)


def _read(table: pa.Table, number: int):
    return [(int(s), pickle.loads(p)) for s, n, p in
            sorted(zip(table["s"].to_pylist(), table["round"].to_pylist(), table["payload"].to_pylist()),
                   key=lambda x: x[:2]) if n == number]


def two_rounds(rows: DataFrame, job, schema: str) -> DataFrame:
    """Questions from buckets of documents to shards of keys and back, twice, then one result per document.

    Documents are spread over buckets of about BUCKET_BYTES by a hash of id and text, so copies do not meet in one
    bucket, and the texts are shuffled once. In each round every bucket sends each shard one message about its
    distinct keys (so a key that a third of all documents share arrives once per bucket) and gets one answer.

    job.first(table)                 -> (shard, message) pairs; table has doc_id and text
    job.answer_first([(b, message)])  -> (b, answer) pairs of one shard
    job.second(table, answers)       -> (shard, message) pairs, given [(shard, answer)] of the first round
    job.answer_second([(b, message)]) -> (b, answer) pairs
    job.finish(table, answers, answers2) -> Arrow table of ``schema``
    job.shards                       is set here
    """
    spark = rows.sparkSession
    n = max(parts(spark), -(-text_bytes(rows) // BUCKET_BYTES))
    job.shards = n
    placed = rows.withColumn("__b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "__b")

    def ask(number):
        def go(key, left, right):
            got = [_read(right, r) for r in range(1, number)]
            b = key[0].as_py()
            if not left.num_rows:
                return _messages([])
            send = (job.first if number == 1 else job.second)(left, *got)
            return _messages((b, int(s), number, pickle.dumps(m, 5)) for s, m in send)
        return go

    def answer(number):
        def go(key, table):
            asked = [(int(b), pickle.loads(p)) for b, p in
                     sorted(zip(table["b"].to_pylist(), table["payload"].to_pylist()), key=lambda x: x[0])]
            s = key[0].as_py()
            return _messages((b, s, number, pickle.dumps(m, 5))
                             for b, m in (job.answer_first if number == 1 else job.answer_second)(asked))
        return go

    def first(key, table):
        return ask(1)(key, table, None)

    def last(key, left, right):
        return job.finish(left, _read(right, 1), _read(right, 2)) if left.num_rows else job.empty

    buckets = placed.groupBy("__b")
    # dealt out by bucket once, for both that read it; else the first answers are worked out twice
    said = buckets.applyInArrow(first, _MESSAGE).groupBy("s").applyInArrow(answer(1), _MESSAGE).repartition(n, "b")
    again = (buckets.cogroup(said.groupBy("b")).applyInArrow(ask(2), _MESSAGE)
             .groupBy("s").applyInArrow(answer(2), _MESSAGE))
    job.empty = pa.table({f.name: pa.array([], _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema})
    return buckets.cogroup(said.unionByName(again).groupBy("b")).applyInArrow(last, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def encode(table: pa.Table) -> list[bytes]:
    """UTF-8 texts of an Arrow table, without decoding them."""
    return table["text"].cast(pa.binary()).to_pylist()

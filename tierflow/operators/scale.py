"""Ordered per-key work that stays exact when one key holds a large share of all rows.

A plain window puts every row of a key in one task. Here rows are cut into buckets
that follow the order (a range of rows, a hash prefix, a message range). One partial
aggregate per (key, bucket) is small; its window gives every bucket what came before
it; and a local window inside the bucket does the rest. The row side is shuffled
once, on (key, bucket).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET = "__bucket"
RANGE = "__range"
RANGES_A_TASK = 4


def scratch_dir(spark) -> str:
    """Scratch folder that the cluster names in spark.checkpoint.dir.

    Without that setting only a session with all its tasks on this machine gets one; elsewhere executors would each write to a
    disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]-]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tierflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tierflow/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared scratch folder and reads it back.

    ``running`` reads its input twice, so a chain of them would double the plan at every
    step. A stage ends that, survives lost executors, and is read with column pruning.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, for tables that grow with the input.

    Spark takes the bytes of a staged Parquet table for its size, also below an explode. Rows are many times that, and a
    table under the broadcast threshold would pass through the driver whole.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def in_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None,
              added: dict[str, Column] | None = None) -> DataFrame:
    """The rows, staged, with the number of their range of (keys, order) in RANGE, a bucket for ``running``.

    Spark samples the rows to cut the ranges, so they hold about equal numbers of rows, whatever share one key or one hour has. Rows equal
    in all of ``keys`` and ``order`` share a range; nulls come first. Ranges are several times as many as tasks, so that hashing evens them out.
    ``added`` are costly columns, computed once per row in its range: before, a few tasks may read all rows, and sampling would compute them again.
    """
    n = ranges or RANGES_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *keys, *order).withColumns({**(added or {}), RANGE: F.spark_partition_id()}))


def as_cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running(df: DataFrame, keys: list[str], order: list, bucket: Column,
            sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None,
            mins: dict[str, Column] | None = None) -> DataFrame:
    """Adds per-key ordered values.

    sums      inclusive running sums
    mins      inclusive running minima
    previous  last non-null value of the expression on an earlier row
    totals    sum over the whole key
    ``order`` must be unique within a key and ``bucket`` must not decrease along it.
    """
    sums, previous, totals, mins = sums or {}, previous or {}, totals or {}, mins or {}
    cols = df.columns
    d = df.withColumn(BUCKET, bucket)
    for i, e in enumerate(sums.values()):
        d = d.withColumn(f"__s{i}", e)
    for i, e in enumerate(previous.values()):
        d = d.withColumn(f"__p{i}", e)
    for i, e in enumerate(totals.values()):
        d = d.withColumn(f"__t{i}", e)
    for i, e in enumerate(mins.values()):
        d = d.withColumn(f"__m{i}", e)
    ordered = as_cols(order)
    aggs = [F.sum(f"__s{i}").alias(f"__S{i}") for i in range(len(sums))]
    aggs += [F.sum(f"__t{i}").alias(f"__T{i}") for i in range(len(totals))]
    aggs += [F.min(f"__m{i}").alias(f"__M{i}") for i in range(len(mins))]
    aggs += [F.max(F.when(F.col(f"__p{i}").isNotNull(),
                          F.struct(*[c.alias(f"o{j}") for j, c in enumerate(ordered)],
                                   F.col(f"__p{i}").alias("v")))).alias(f"__P{i}")
             for i in range(len(previous))]
    part = d.groupBy(*keys, BUCKET).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(BUCKET)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = [F.coalesce(F.sum(f"__S{i}").over(before), F.lit(0)).alias(f"__cs{i}")
             for i in range(len(sums))]
    carry += [F.min(f"__M{i}").over(before).alias(f"__cm{i}") for i in range(len(mins))]
    carry += [F.last(f"__P{i}", ignorenulls=True).over(before)["v"].alias(f"__cp{i}")
              for i in range(len(previous))]
    carry += [F.sum(f"__T{i}").over(whole).alias(n) for i, n in enumerate(totals)]
    part = part.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                       F.col(BUCKET).alias("__kb"), *carry)
    on = F.col(BUCKET) == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    j = d.join(part, on)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*ordered)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in cols]
    out += [(F.col(f"__cs{i}") + F.sum(f"__s{i}").over(upto)).alias(n)
            for i, n in enumerate(sums)]
    out += [F.least(F.col(f"__cm{i}"), F.min(f"__m{i}").over(upto)).alias(n)
            for i, n in enumerate(mins)]
    out += [F.coalesce(F.last(f"__p{i}", ignorenulls=True).over(prior), F.col(f"__cp{i}")).alias(n)
            for i, n in enumerate(previous)]
    out += [F.col(n) for n in totals]
    return j.select(*out)


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    """Slice number of a timestamp. A busy slice is one task; ``in_ranges`` cuts by the rows instead."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    return F.floor((day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
                   / F.lit(seconds)).cast("long")


def position_bucket(pos: Column, width: int = 4096) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def uniform_hash(value: Column, seed) -> Column:
    """32 uniform bits of md5(value:seed), reproducible in any engine with md5."""
    digest = F.md5(F.concat_ws(":", value.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def unit_hash(value: Column, seed) -> Column:
    return uniform_hash(value, seed) / F.lit(4294967296.0)


def shuffled_rank(df: DataFrame, keys: list[str], id_col: str, seed, rank: str = "rank",
                  total: str = "total", buckets: int = 4096) -> DataFrame:
    """Seeded random rank (1-based) inside each key, and the key's size.

    The hash order itself is the bucketing, so even a key with a third of all rows
    is spread over ``buckets`` tasks.
    """
    h = df.withColumn("__h", uniform_hash(F.col(id_col), seed))
    return running(h, keys, ["__h", id_col], F.floor(F.col("__h") / F.lit(4294967296 // buckets)),
                   sums={rank: F.lit(1).cast("long")},
                   totals={total: F.lit(1).cast("long")}).drop("__h")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                salts: int = 64, rank: str = "rank") -> DataFrame:
    """First n rows per key. Salted sub-groups are cut to n before they meet."""
    ids = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns
                              if dict(df.dtypes)[c] != "void" and "map" not in dict(df.dtypes)[c]]),
                 F.lit(salts))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__salt", ids).withColumn("__r", F.row_number().over(w1))
            .where(F.col("__r") <= n).drop("__salt", "__r")
            .withColumn(rank, F.row_number().over(w2)).where(F.col(rank) <= n))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole first row per key, as an aggregate: copies meet already before the shuffle."""
    cols = df.columns
    rest = [c for c in cols if c not in keys and c not in order]
    best = F.min_by(F.struct(*[F.col(c) for c in order + rest]),
                    F.struct(*[F.col(c) for c in order])).alias("__first")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col("__first")[c].alias(c) for c in cols])


def with_halo(df: DataFrame, position: str, back: int, size: int = 8192) -> DataFrame:
    """Chunks of ``size`` consecutive rows, each with the last ``back`` rows of the chunk
    before it. ``position`` is a 1-based number inside the key. Use ``__chunk`` in the
    window's partition and drop rows with ``__halo`` afterwards."""
    zero = F.col(position) - 1
    chunk = F.floor(zero / F.lit(size)).cast("long")
    tail = (zero % size) >= (size - back)
    copies = F.when(tail, F.array(F.struct(chunk.alias("c"), F.lit(False).alias("h")),
                                  F.struct((chunk + 1).alias("c"), F.lit(True).alias("h")))) \
        .otherwise(F.array(F.struct(chunk.alias("c"), F.lit(False).alias("h"))))
    return (df.withColumn("__e", F.explode(copies))
            .withColumn("__chunk", F.col("__e.c")).withColumn("__halo", F.col("__e.h")).drop("__e"))


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, (list, tuple)):
        return "array(" + ",".join(_sql_literal(x) for x in v) + ")"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{text}'"


def dimension(spark, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed-size table as a local relation; its size does not depend on the data."""
    body = ",".join("(" + ",".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({','.join(columns)})")

"""Hard negatives by a secondary sort: each anchor's scores arrive in descending order and pass through the windows of its positives.

Scores of anchors against all rows are made block by block as matrix products. Before the shuffle a block keeps, of each anchor, only its
best positives and, once the positives are known, the first negatives of each window; that loses nothing, because what comes first
over all blocks comes first in its block. The rest is packed into (anchor, descending score, id) keys, sorted by
``repartitionAndSortWithinPartitions``, and read as a stream that holds the open windows of one anchor.
"""

from __future__ import annotations

import struct
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tierflow.llm.common import parts
from tierflow.operators.scale import staged

POSITIVES = 5
NEGATIVES = 3
BAND = (50, 95)  # per cent of the positive's score, both included
ROWS, ANCHORS = 1 << 15, 1 << 13  # rows and anchors of a block at most, about
LEAST_ROWS = 1 << 10
CELLS = 1 << 22  # scores made at a time
_TOP = (1 << 63) - 1


def whole(vector) -> F.Column:
    """floor(256 x) of each component, as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("double"))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one for each vec_id."""
    v = F.col(f"`{vector}`").cast("array<double>")
    limit = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), v.alias("v"),
                          fine.alias("fine")).where("vec_id is not null and label is not null and v is not null and fine")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", F.col("r.label").alias("label"), F.col("r.v").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Whole numbers of a list column as rows of ``width``; shorter vectors end in zeros."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return np.floor(out * 256.0)


def _scores(a: np.ndarray, b: np.ndarray, rows: int):
    """Yields (first anchor, keys): key = score * rows + (rows - 1 - place), so larger keys come first and ties go to earlier rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    place = rows - 1 - np.arange(rows)
    fast = most < 2.0 ** 53 and most * rows < 2.0 ** 62
    if not fast:  # numbers of any size, exact
        a, b = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b))
    step = max(1, CELLS // max(1, rows))
    for i in range(0, len(a), step):
        s = a[i:i + step] @ b.T
        yield i, (s.astype(np.int64) if fast else s) * rows + place


def _block(left: pa.Table, right: pa.Table):
    """Anchors and rows of a block: rows by vec_id, matrices of equal width, and the key below all others."""
    right = right.take(pc.sort_indices(right["vec_id"]))
    width = max((pc.max(pc.list_value_length(t["v"])).as_py() or 0) for t in (left, right))
    return left, right, _matrix(left["v"], width), _matrix(right["v"], width)


def _grid(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], job, schema: str) -> DataFrame:
    """``job(anchors, rows)`` for every block of anchors with every block of rows."""
    of_rows, of_anchors = blocks
    wide = (rows.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(of_rows)))
            .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(of_anchors - 1)))))
    many = (anchors.toDF(*anchors.columns)  # columns of their own, as anchors come from rows
            .withColumn("p", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(of_anchors)).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of_rows - 1).cast("bigint")))))
    empty = pa.schema([("anchor_id", pa.int64()), ("score", pa.decimal128(38, 0)), ("id", pa.int64())]).empty_table()

    def go(key, left, right):
        return job(left, right) if left.num_rows and right.num_rows else empty

    return many.groupBy("p", "q").cogroup(wide.groupBy("p", "q")).applyInArrow(go, schema)


_FOUND = "anchor_id bigint, score decimal(38,0), id bigint"


def _found(anchor, key, at, n: int, ids) -> pa.Table:
    """Rows for the keys found: whose score, and of which vec_id."""
    score = [max(-_TOP, min(_TOP, int(k) // n)) for k in key]
    return pa.table([pa.array(anchor, pa.int64()), pa.array(score, pa.decimal128(38, 0)), pa.array(ids[np.asarray(at, np.int64)], pa.int64())],
                    names=["anchor_id", "score", "id"])


def positives(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], n: int = POSITIVES) -> DataFrame:
    """(anchor_id, score, id): each anchor's first ``n`` other rows of its label."""
    def job(left, right):
        left, right, a, b = _block(left, right)
        m = len(b)
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        own, of = left["vec_id"].to_numpy(), left["label"].to_numpy()
        who, keys = [], []
        for i, key in _scores(a, b, m):
            fits = (labels == of[i:i + len(key), None]) & (ids != own[i:i + len(key), None])
            for j, k in enumerate(key):
                k = k[fits[j]]
                if len(k) > n:
                    k = np.partition(k, len(k) - n)[len(k) - n:]
                who += [own[i + j]] * len(k)
                keys += k.tolist()
        return _found(who, keys, [m - 1 - k % m for k in keys], m, ids)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    return _grid(rows, anchors, blocks, job, _FOUND).withColumn("r", F.row_number().over(first)).where(F.col("r") <= n).drop("r")


def window_heads(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], n: int, band: tuple[int, int]) -> DataFrame:
    """(anchor_id, score, id): of each block, an anchor's first ``n`` rows of other labels in each of its windows; anchors hold ``scores``."""
    low, high = band

    def job(left, right):
        left, right, a, b = _block(left, right)
        m = len(b)
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        own, of, scores = left["vec_id"].to_numpy(), left["label"].to_numpy(), left["scores"].to_pylist()
        who, keys = [], []
        for i, key in _scores(a, b, m):
            fits = labels != of[i:i + len(key), None]
            for j, k in enumerate(key):
                k = np.sort(k[fits[j]])
                chosen = set()
                for p in {int(s) for s in scores[i + j]}:
                    # low p <= 100 score <= high p, for whole scores
                    least, most = -(-low * p // 100), high * p // 100
                    end = np.searchsorted(k, (most + 1) * m)
                    start = max(np.searchsorted(k, least * m), end - n)
                    chosen.update(k[start:end].tolist())
                who += [own[i + j]] * len(chosen)
                keys += chosen
        return _found(who, keys, [m - 1 - k % m for k in keys], m, ids)

    return _grid(rows, anchors, blocks, job, _FOUND)


_KEY = struct.Struct(">QQ?Q")
_HALF = 1 << 63


def packed(anchor: int, score: int, row: int, negative: bool) -> bytes:
    """Bytes that sort by anchor, descending score, positives before negatives, then id: a window also holds negatives that score as its positive."""
    return _KEY.pack(anchor + _HALF, _HALF - 1 - score, negative, row + _HALF)


def unpacked(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, negative, row = _KEY.unpack(key)
    return anchor - _HALF, _HALF - 1 - score, row - _HALF, negative


def mined(scored, n: int = NEGATIVES, band: tuple[int, int] = BAND):
    """Rows (anchor, positive, rank, negative, scores) from a stream of packed keys in order.

    A positive opens a window; a negative goes to every window that it is in; a window ends with its ``n``-th negative, or with the first
    score below it.
    """
    low, high = band
    for anchor, stream in groupby(map(unpacked, scored), key=lambda x: x[0]):
        opened: list[list] = []  # positive, its score, negatives so far
        for _, score, row, negative in stream:
            if not negative:
                opened.append([row, score, 0])
                continue
            still = []
            for w in opened:
                if 100 * score < low * w[1]:
                    continue
                if 100 * score <= high * w[1]:
                    w[2] += 1
                    yield anchor, w[0], w[2], row, w[1], score
                if w[2] < n:
                    still.append(w)
            opened = still


def hard_negatives(vectors: DataFrame, anchors, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
                   rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchors`` is a condition on vec_id and label. A score is the inner product of the vectors' floor(256 x).
    An anchor's positives are its first ``n_positives`` other rows of its label, by descending score and ascending vec_id; for each, the first
    ``n_negatives`` rows of other labels come back whose score is ``band`` per cent of the positive's. Rows with a null vec_id,
    label or vector or a component that is null or not finite take no part; of several rows with one vec_id the one with the
    smallest label, then vector, does; a shorter vector counts as if it ended in zeros; scores beyond 64 bits are cut to the largest there is (exact ones
    decide inside a block); an empty table or no anchor gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors))
    chosen = rows.where(anchors)
    n, m = rows.count(), chosen.count()
    blocks = max(1, -(-n // rows_per_block), min(parts(spark), n // LEAST_ROWS)), max(1, -(-m // anchors_per_block))
    good = staged(positives(rows, chosen, blocks, n_positives))
    windows = good.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("scores"))  # n_positives at most
    bad = window_heads(rows, chosen.join(windows, "vec_id"), blocks, n_negatives, band)
    scored = good.withColumn("negative", F.lit(False)).unionByName(bad.withColumn("negative", F.lit(True)))
    keyed = scored.select("anchor_id", F.col("score").cast("bigint").alias("score"), "id", "negative").rdd.map(lambda r: (packed(*r), None))
    ordered = keyed.repartitionAndSortWithinPartitions(parts(spark), lambda key: zlib.crc32(key[:8])).keys()
    return spark.createDataFrame(ordered.mapPartitions(lambda it: mined(it, n_negatives, band)),
                                 "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

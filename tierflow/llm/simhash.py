"""SimHash near-dedup with a vantage-point forest over fingerprints.

Two fingerprints that differ in few bits differ in half as many in one of two halves, so each half is searched with half the distance.
A half's tree sends fingerprints left (near the vantage point) or right, level by level; those just beyond the
boundary, by no more than the distance, go left as well, so every close pair shares a leaf. Leaves are partitions of
the cluster; inside one the full distance is searched with triangle bounds. Only distinct fingerprints travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.common import doc_rows, encode
from tierflow.llm.components import components
from tierflow.operators.scale import staged

SHINGLE, DISTANCE, SEED = 3, 3, 42
LEAF = 2048
BLOCK = 4096


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; repeated shingles count each time."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    begin = (ends - [len(w) + 1 for w in words])[:n].tolist()
    end = (ends - 1)[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        h = np.array([digest(flat[x:y], SEED) for x, y in zip(begin[a:a + (1 << 16)], end[a:a + (1 << 16)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number), one row per row."""
    def go(batches):
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in encode(pa.Table.from_batches([b]))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp, pa.int64())], ["doc_id", "fp"])
    return doc_rows(docs).mapInArrow(go, "doc_id bigint, fp bigint")


def forest(levels: int, low_bits: int, seed: int) -> np.ndarray:
    """Vantage points of one half's tree: a fixed one per level, spread over all bits of the half."""
    return np.random.default_rng(seed).integers(0, 1 << low_bits, levels, dtype=np.uint64)


def leaves(fp: np.ndarray, points: np.ndarray, cuts: np.ndarray, shift: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each fingerprint; rows up to ``reach`` beyond a boundary are on both sides of it."""
    row, leaf = np.arange(len(fp)), np.ones(len(fp), np.int64)
    half = (fp >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
    for p, c in zip(points, cuts):
        d = np.bitwise_count(half[row] ^ p)
        both = (d > c) & (d <= c + reach)
        leaf = leaf * 2 + (d > c)
        row, leaf = np.concatenate([row, row[both]]), np.concatenate([leaf, leaf[both] - 1])
    return row, leaf


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int):
    """Index pairs (i in a, j in b) within the distance, through rings around a vantage point.

    ``b`` is sorted by its distance to the point; by the triangle inequality only rings at most ``distance`` apart
    are compared.
    """
    if not len(a) or not len(b):
        return
    point = b[len(b) // 2]
    da, db = np.bitwise_count(a ^ point).astype(np.int64), np.bitwise_count(b ^ point).astype(np.int64)
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    ca, cb = np.searchsorted(da[oa], np.arange(66)), np.searchsorted(db[ob], np.arange(66))
    for ring in range(65):
        rows = oa[ca[ring]:ca[ring + 1]]
        cols = ob[cb[max(0, ring - distance)]:cb[min(65, ring + distance + 1)]]
        for s in range(0, len(rows), 256):
            i, j = np.nonzero(np.bitwise_count(a[rows[s:s + 256], None] ^ b[None, cols]) <= distance)
            yield rows[s:s + 256][i], cols[j]


def spanning(x: np.ndarray, y: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join whatever close pairs between x and y join: fewer than len(x) + len(y), not one per pair."""
    both = np.unique(np.concatenate([x, y]))
    parent = np.arange(len(both))
    of_x, of_y = np.searchsorted(both, x), np.searchsorted(both, y)

    def roots(i):
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        return parent[i]

    for i, j in close_pairs(x, y, distance):
        i, j = roots(of_x[i]), roots(of_y[j])
        while len(i := i[keep := i != j]):  # hang the larger root on the smaller, until no pair is apart
            j = j[keep]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
            i, j = roots(i), roots(j)
    root = roots(np.arange(len(both)))
    return [(int(a), int(b)) for a, b in zip(both[root].view(np.int64), both.view(np.int64)) if a != b]


def links(fps: DataFrame, distance: int = DISTANCE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(a, b) links between distinct fingerprints whose connected parts are those of all pairs within the distance.

    A leaf with more than ``block`` fingerprints is dealt into blocks, and each pair of blocks is a task of its own.
    """
    spark = fps.sparkSession
    n = fps.count()
    reach = distance // 2
    levels = max(0, int(np.ceil(np.log(max(1, n / leaf)) / np.log(2 / 1.15)))) if n > leaf else 0
    halves = []
    for shift in (0, 32):
        points = forest(levels, 32, 11 + shift)
        # the cut of a level is the middle of a half's distances, which needs counts of 33 values only
        cuts = _middles(fps, points, shift) if levels else np.zeros(0, np.int64)
        halves.append((shift, points, cuts))

    def place(batches):
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for shift, points, cuts in halves:
                row, at = leaves(fp, points, cuts, shift, reach)
                yield pa.RecordBatch.from_arrays([pa.array(at * 2 + (shift > 0), pa.int64()), pa.array(fp[row].view(np.int64))],
                                                 ["leaf", "fp"])

    placed = staged(fps.mapInArrow(place, "leaf bigint, fp bigint"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = (placed.join(sizes.withColumn("k", blocks), "leaf").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp"))

    def search(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        mine, fp = table["mine"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        x, y = np.unique(fp[mine == i]), np.unique(fp[mine == j])
        return _links(spanning(x, y, distance))

    return dealt.groupBy("leaf", "i", "j").applyInArrow(search, "a bigint, b bigint")


def _links(pairs) -> pa.Table:
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _middles(fps: DataFrame, points: np.ndarray, shift: int) -> np.ndarray:
    half = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
    near = fps.select(F.posexplode(F.array(*[F.bit_count(half.bitwiseXOR(F.lit(int(p)))) for p in points])).alias("level", "d"))
    rows = near.groupBy("level", "d").count().collect()
    counts = np.zeros((len(points), 33), np.int64)
    for r in rows:
        counts[r["level"], r["d"]] = r["count"]
    below = np.cumsum(counts, 1) / counts.sum(1, keepdims=True)
    return np.abs(below - 0.47).argmin(1)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), one row per row of ``docs``.

    Words are lower-cased (A-Z) runs of bytes other than 0x20 and 0x09-0x0D; shingles of ``size`` words count with
    their repeats; a text with fewer words is one shingle, one without words (or null) has fingerprint zero, linked like
    any other. Fingerprints link at ``distance`` differing bits or fewer. A null doc_id keeps its row and never names a component
    unless all of it are null; repeated rows share a component; an empty table gives no rows; other columns are ignored.
    """
    rows = staged(fingerprints(docs, size))
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(fps.select("fp"), distance))  # node, root of every fingerprint that has a link
    named = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # components of one fingerprint need no more work; others take the least doc_id over theirs
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "root").join(whole, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: the smallest doc_id, one row of it.

    A component whose doc_ids are all null keeps one row. Empty texts are one component.
    """
    # A component is known by its least row: (doc_id, hash of the text, place in the table), which also settles repeated rows.
    row = F.monotonically_increasing_id()
    numbered = staged(docs.withColumn("__row", row))
    marked = staged(_with_row(numbered, size))
    fps = staged(marked.groupBy("fp").agg(F.min("key").alias("least")))
    joined = components(links(fps.select("fp"), distance))
    named = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    return numbered.join(stay, "__row", "left_semi").select(docs.columns)


def _with_row(numbered: DataFrame, size: int) -> DataFrame:
    def go(batches):
        for b in batches:
            texts = b["text"].cast(pa.binary()).fill_null(b"").to_pylist()
            fp = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(fp, pa.int64())], ["doc_id", "row", "fp"])
    rows = numbered.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__row").alias("row"))
    out = rows.mapInArrow(go, "doc_id bigint, row bigint, fp bigint")
    return out.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"))

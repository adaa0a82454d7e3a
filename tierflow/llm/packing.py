"""Vector best-fit packing of tokenized documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.common import doc_rows
from tierflow.llm.tokens import balanced, encoder

TOKENIZER = "word_bpe_49k.json"
TOKENS = 4096
GROUP = 16384  # pieces packed by one task at a time
BATCH_BYTES = 1 << 20


def best_fit(demand: np.ndarray, capacity: np.ndarray, rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and position (token offset) of each item; column 0 of ``demand`` is tokens.

    Items go in falling order of their largest share of a capacity. A bin is open to an item if no capacity would be
    passed. "dot": the bin with the least dot product of weighted demand and residual capacity left after placing, that is the one whose
    free room in what the item needs is smallest; "norm": the bin with the least weighted norm of the residual.
    Weights are each dimension's total demand in shares of the capacity, so a scarce dimension counts more.
    Equal items are interchangeable; ties go to the older bin.
    """
    n = len(demand)
    share = demand / capacity
    weight = share.sum(0) / max(share.sum(), 1e-300)
    order = np.lexsort((np.arange(n), -share.max(1))) if n else np.zeros(0, np.int64)
    free = np.ones((max(n, 1), demand.shape[1]))
    free[:] = capacity
    used, live = 0, np.zeros(0, np.int64)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    floor = demand.min(0) if n else capacity
    for i in order:
        d = demand[i]
        room = free[live]
        fits = np.flatnonzero((room >= d).all(1))
        if len(fits):
            rest = (room[fits] - d) / capacity
            score = rest @ (weight * share[i]) if rule == "dot" else (rest * rest) @ weight
            b = live[fits[np.argmin(score)]]
        else:
            b, used = used, used + 1
            live = np.append(live, b)
        bins[i], offset[i] = b, capacity[0] - free[b, 0]
        free[b] -= d
        if (free[b] < floor).any():  # full: no item left fits
            live = live[live != b]
    return bins, offset


def pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = TOKENS, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; ids end with ``end``."""
    def cut(batches):
        own = encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            for a, b in balanced(pc.binary_length(batch["text"]).to_pylist(), BATCH_BYTES):
                names, rows = batch["doc_id"].slice(a, b - a).to_pylist(), []
                for name, ids in zip(names, own.encode(batch["text"].slice(a, b - a).to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), max_tokens)):
                        part = ids[s:s + max_tokens]
                        rows.append((name, k, s, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_rows(docs).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = TOKENS, max_docs: int | None = None,
         max_attention: float | None = None, rule: str = "dot", group: int = GROUP) -> DataFrame:
    """Packs all documents into sequences under three capacities: tokens, documents, attention cost (sum of squared lengths).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than ``max_tokens``
    are cut. Defaults of ``max_docs`` and ``max_attention`` are the most that ``max_tokens`` allows, so they bind only where given;
    a piece that alone costs more than ``max_attention`` is an error. Pieces are packed in groups of
    about ``group`` by a hash, in parallel; a group leaves a few part-filled sequences at most.
    A null text is empty and gives one piece, the end id; a null doc_id stays null; repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.
    """
    most = (max_tokens, max_docs or max_tokens, max_attention or float(max_tokens) ** 2)
    if most[2] < float(max_tokens) ** 2 and max_attention:
        max_tokens = min(max_tokens, int(most[2] ** 0.5))  # a piece must fit on its own
    capacity = np.array(most, float)
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, tokenizer, max_tokens).withColumn("row", F.monotonically_increasing_id())

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        size = table["length"].to_numpy().astype(float)
        bins, offset = best_fit(np.stack([size, np.ones_like(size), size * size], 1), capacity, rule)
        base = int(table["g"][0].as_py()) << 32
        return pa.table([*(table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                         pa.array(bins + base, pa.int64()), pa.array(offset, pa.int64())],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups))).groupBy("g").applyInArrow(place, schema)

"""Substring deduplication by relative Lempel-Ziv parsing of word sequences.

In each shard of shared segments (see windows.py) the reference block is indexed by its windows. Segments are taken
by place in the corpus; each is factored greedily against everything earlier, a factor at least a window long is a
duplicate span, and the parse goes on at the first window that crosses the factor's end, so that a window made of the
ends of two factors is looked up too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tierflow.llm.common import doc_rows, held, two_rounds
from tierflow.llm.windows import SharedWindows, kept

WINDOW = 20
MEMO = 500_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; known words are looked up, in a table that is emptied when full."""
    memo = held("words", dict)
    get = memo.get
    out = [get(w) for w in words]
    if None in out:
        if len(memo) > MEMO:
            memo.clear()
        for i, (h, w) in enumerate(zip(out, words)):
            if h is None:
                out[i] = memo[w] = xxhash.xxh64_intdigest(w)
    return np.array(out, np.uint64)


class _Words(SharedWindows):
    def load(self, text):
        return text.split()  # ASCII white space: 0x20 and 0x09 to 0x0D

    def hashes(self, doc, a, b):
        return word_hashes(doc[a:b])

    def piece(self, doc, a, b):
        return b" ".join(doc[a:b])

    def place(self, doc_id, start):
        return doc_id, start

    def repeated(self, segments, places):
        block: dict[bytes, tuple[int, int]] = {}  # window -> (segment, first word) of the reference
        parsed, out, w = [], [], self.window
        for j, text in enumerate(segments):
            words = text.split(b" ")
            ends = np.cumsum([len(x) + 1 for x in words]).tolist()
            begins = [0, *ends]
            parsed.append(words)
            runs, i, last = [], 0, len(words) - w
            while i <= last:
                at = block.get(window := text[begins[i]:ends[i + w - 1] - 1])
                if at is None:
                    block[window] = (j, i)
                    i += 1
                    continue
                source, start = parsed[at[0]], at[1]
                size = w
                while i + size < len(words) and start + size < len(source) and source[start + size] == words[i + size]:
                    size += 1
                if runs and runs[-1][1] >= i:
                    runs[-1] = (runs[-1][0], i + size - w + 1)
                else:
                    runs.append((i, i + size - w + 1))
                i += size - w + 1
            out.append(runs)
        return out

    def result(self, names, texts, docs, removed):
        rows = [(n, len(d), sum(b - a for a, b in r), r, b" ".join(w for a, b in kept(len(d), r) for w in d[a:b]))
                for n, d, r in zip(names, docs, removed)]
        return pa.table({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_words": pa.array([r[1] for r in rows], pa.int64()),
            "n_removed": pa.array([r[2] for r in rows], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array([r[4].decode() for r in rows], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())})


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = 8) -> DataFrame:
    """Cuts every word covered by ``window`` consecutive words that also start earlier (smaller doc_id, or the same document).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Returns doc_id, n_words, n_removed, spans (removed runs of
    words, half-open), kept (words left, joined by one space) and kept_sha256, one row per row of ``docs``. Windows
    are judged on the input. A null text has no words; a null doc_id counts as larger than all others; rows with one doc_id
    are compared by their windows' starts; an empty table gives no rows; other columns are ignored.
    """
    return two_rounds(doc_rows(docs), _Words(window, min(anchor, window)),
                      "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string, kept_sha256 string")

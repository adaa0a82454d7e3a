"""Suffix-array deduplication: byte strings that occur in an earlier document are cut.

Each shard of shared segments (see windows.py) is one text. Suffixes smaller than their successor are sorted
directly; the rest follow from scans over the first-byte buckets, in which every sorted suffix places the one that
starts a byte before it; then the common prefixes of neighbours show which windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierflow.llm.common import doc_rows, two_rounds
from tierflow.llm.windows import PIECE, SharedWindows, grams, kept

WINDOW = 50
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def _words(text: np.ndarray, at: np.ndarray, word: int) -> np.ndarray:
    """Bytes 8*word to 8*word+7 of the suffixes at ``at``, as numbers that compare like the bytes."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return view[np.minimum(at + 8 * word, len(view) - 1)].astype(np.uint64)


def _sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes at least, eight at a time; only ties go on."""
    if not len(at):
        return at
    key = _words(text, at, 0)
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    tied = np.arange(len(at))
    for word in range(1, -(-depth // 8)):
        size = np.bincount(group)
        more = size[group] > 1
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        key = _words(text, at[tied], word)
        order = np.lexsort((key, group))
        at[tied] = at[tied][order]
        key, group = key[order], group[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
    return at


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes marked in ``wanted``, sorted by their first ``depth`` bytes at least.

    ``text`` is uint8 and ends with eight zeros or more. A suffix needs the ones after it up to the next that is smaller than
    its successor, so these are sorted with it.
    """
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(differs, np.arange(n - 1))
    ends = np.minimum(nxt, len(differs) - 1)
    small = np.zeros(n, bool)
    if len(differs):
        d = differs[ends]
        small[:-1] = (text[d] < text[d + 1]) & (nxt < len(differs))
    small[-1] = True
    stop = np.flatnonzero(small)
    need = np.zeros(n + 1, np.int32)
    mark = np.flatnonzero(wanted)
    np.add.at(need, mark, 1)
    np.add.at(need, stop[np.searchsorted(stop, mark)] + 1, -1)
    need = np.cumsum(need[:-1]) > 0
    direct = _sort(text, np.flatnonzero(need & small), depth)
    large = need & ~small
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        last = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = [last]
        while len(last):  # runs of one byte: each suffix places its predecessor in the same bucket
            before = last[last > 0] - 1
            last = before[large[before] & (text[before] == c)]
            bucket.append(last)
        bucket.append(direct[cut[c]:cut[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[large[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for b in np.unique(first):
            waiting[b].append(before[np.searchsorted(first, b):np.searchsorted(first, b, "right")])
    full = np.concatenate(out) if out else np.zeros(0, np.int64)
    return full[wanted[full]]


def neighbours(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares its first ``depth`` bytes with the one before it in ``order``."""
    same = np.ones(max(0, len(order) - 1), bool)
    for word in range(-(-depth // 8)):
        left = min(8, depth - 8 * word)
        live = np.flatnonzero(same)
        shift = np.uint64(64 - 8 * left)
        same[live] = (_words(text, order[live], word) >> shift) == (_words(text, order[live + 1], word) >> shift)
    return np.concatenate([[False], same]) if len(order) else same


def maybe_again(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Those of the windows at ``starts`` that may occur again, by a table of hashes; one that does is never missed."""
    n, bits = len(text) - window + 1, min(32, max(10, len(starts).bit_length() + 1))
    slot = np.empty(n, np.uint32)
    for a in range(0, n, PIECE):
        part = text[a:a + PIECE + window - 1]
        slot[a:a + len(part) - window + 1] = grams(_TABLE[part], window) >> np.uint64(64 - bits)
    slot = slot[starts]
    number = np.arange(len(starts), dtype=np.uint32)
    last = np.zeros(1 << bits, np.uint32)
    last[slot] = number
    again = np.zeros(1 << bits, bool)
    again[slot[last[slot] != number]] = True
    return starts[again[slot]]


class _Bytes(SharedWindows):
    def load(self, text):
        return text

    def hashes(self, doc, a, b):
        return _TABLE[np.frombuffer(doc, np.uint8, b - a, a)]

    def piece(self, doc, a, b):
        return doc[a:b]

    def place(self, doc_id, start):
        return doc_id, 0

    def repeated(self, segments, places):
        if not segments:
            return []
        text = np.frombuffer(b"\0".join(segments) + bytes(self.window + 64), np.uint8)
        sizes = np.array([len(s) for s in segments])
        at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        count = sizes - self.window + 1
        owner = np.repeat(np.arange(len(segments)), count)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[owner]
        wanted = np.zeros(len(text), bool)
        wanted[maybe_again(text, starts, self.window)] = True
        of = np.zeros(len(text), np.int64)
        of[starts] = owner
        order = two_stage(text, wanted, self.window)
        group = np.cumsum(~neighbours(text, order, self.window)) - 1
        doc = places[of[order], 0]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        earliest = np.minimum.reduceat(doc, head)[group]
        hit = np.zeros(len(text), bool)
        hit[order[earliest < doc]] = True
        out: list[list[tuple[int, int]]] = [[] for _ in segments]
        flag = hit[starts]
        cut = np.flatnonzero(np.concatenate([[True], (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(flag)).tolist()):
            if flag[a]:
                base = int(starts[a] - at[owner[a]])
                out[owner[a]].append((base, base + b - a))
        return out

    def result(self, names, texts, docs, removed):
        rows = [(n, len(t), sum(b - a for a, b in r), r, b"".join(t[a:b] for a, b in kept(len(t), r)))
                for n, t, r in zip(names, texts, removed)]
        return pa.table({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_bytes": pa.array([r[1] for r in rows], pa.int64()),
            "n_removed": pa.array([r[2] for r in rows], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array([r[4] for r in rows], pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())})


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = 20) -> DataFrame:
    """Cuts every byte covered by a ``window``-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, spans (removed runs, half-open, in bytes), kept (the bytes left; a cut may fall inside a character) and
    kept_sha256, one row per row of ``docs``. Strings are judged on the input and never cross documents.
    A null text is empty; a null doc_id counts as larger than all others; rows with one doc_id do not cut each other;
    an empty table gives no rows; other columns are ignored.
    """
    return two_rounds(doc_rows(docs), _Bytes(window, min(anchor, window)),
                      "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")

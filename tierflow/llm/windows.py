"""Windows of consecutive units (bytes, words) that occur more than once, found without shipping every window.

Every window holds one anchor: its smallest k-gram by hash, the leftmost on ties, which depends on the window's
content alone. First round: buckets send the hashes of their anchors, and learn which ones occur again. Second round:
runs of windows around such an anchor ("segments": consecutive windows with one anchor) go to the anchor's shard as
text, each distinct segment once per bucket with its first place. Equal windows have equal anchors, so they meet in
one shard, where the subclass compares the text itself. Hashes of anchors only choose candidates; a whole text that was there before is told by its sha256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tierflow.llm.common import encode, ids, split_by

PIECE = 1 << 20
_POS = np.uint64((1 << 31) - 1)
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64; a worker keeps those of PIECE units."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        steps = np.full((2, size), _STEP, np.uint64)
        steps[1] = pow(_STEP, -1, 1 << 64)
        steps[:, 0] = 1
        _powers[:] = np.multiply.accumulate(steps, 1)
    return _powers[0][:n], _powers[1][:n]


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of units[i:i+k] for every i, from running sums of units times powers."""
    n = len(units) - k + 1
    up, down = powers(len(units))
    total = np.cumsum(units * up)
    out = total[k - 1:].copy()
    out[1:] -= total[:n - 1]
    out *= down[:n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def least(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for every i."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return v if size == w else np.minimum(v[:len(v) - (w - size)], v[w - size:])


class SharedWindows:
    """Job for two_rounds. A subclass says what units are, compares segments, and finishes a document."""

    shards = 1

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    # --- of the subclass -------------------------------------------------------------------------------------------
    def load(self, text: bytes):
        """The document as a sequence of units, with len()."""
        raise NotImplementedError

    def hashes(self, doc, a: int, b: int) -> np.ndarray:
        raise NotImplementedError

    def piece(self, doc, a: int, b: int) -> bytes:
        raise NotImplementedError

    def place(self, doc_id: int, start: int) -> tuple[int, int]:
        """Order of windows: a window is removed if an equal one has a smaller place."""
        raise NotImplementedError

    def repeated(self, segments: list[bytes], places: np.ndarray) -> list[list[tuple[int, int]]]:
        """For distinct segments, sorted by place: the runs [from, to) of windows that an earlier segment holds."""
        raise NotImplementedError

    def result(self, names, texts, docs, removed) -> pa.Table:
        raise NotImplementedError

    # --- anchors ---------------------------------------------------------------------------------------------------
    def runs(self, docs: list):
        """Arrays (doc index, first window, windows, anchor hash), over batches of PIECE units; long documents are cut."""
        batch, size = [], 0
        for i, d in enumerate(docs):
            n = len(d)
            for a in range(0, max(0, n - self.window + 1), PIECE):
                b = min(n, a + PIECE + self.window - 1)
                batch.append((i, a, self.hashes(d, a, b)))
                size += b - a
                if size >= PIECE:
                    yield self._runs(batch)
                    batch, size = [], 0
        if batch:
            yield self._runs(batch)

    def _runs(self, batch):
        sizes = np.array([len(x[2]) for x in batch])
        at = np.concatenate([[0], np.cumsum(sizes)])
        g = grams(np.concatenate([x[2] for x in batch]), self.k)
        v = ((g >> np.uint64(31)) << np.uint64(31)) | np.arange(len(g), dtype=np.uint64)
        best = (least(v, self.window - self.k + 1) & _POS).astype(np.int64)
        edge = np.zeros(len(best) + 1, np.int8)
        np.add.at(edge, at[:-1], 1)
        np.add.at(edge, np.minimum(at[1:] - self.window + 1, len(best)), -1)
        own = np.flatnonzero(np.cumsum(edge[:-1]))
        best = best[own]
        cut = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (own[1:] != own[:-1] + 1)]))
        start, count = own[cut], np.diff(np.append(cut, len(own)))
        part = np.searchsorted(at, start, "right") - 1
        doc = np.array([x[0] for x in batch])[part]
        base = np.array([x[1] for x in batch])[part]
        return doc, start - at[part] + base, count, g[best[cut]]

    def keyed(self, anchor: np.ndarray):
        shard = (anchor >> np.uint64(32)) % np.uint64(self.shards)
        return shard.astype(np.int64), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    # --- rounds ----------------------------------------------------------------------------------------------------
    def read(self, table: pa.Table):
        """Names and texts, in an order that does not depend on how rows arrived."""
        names, texts = ids(table["doc_id"]), encode(table)
        order = sorted(range(len(texts)), key=lambda i: (names[i], texts[i]))
        return names[order], [texts[i] for i in order]

    def digests(self, names, texts) -> dict[bytes, int]:
        """Smallest name of each text that holds a window at all."""
        out: dict[bytes, int] = {}
        for name, t in zip(names.tolist(), texts):
            if len(t) >= self.window:
                d = hashlib.sha256(t).digest()
                out[d] = min(name, out.get(d, name))
        return out

    def first(self, table):
        names, texts = self.read(table)
        found = [r[3] for r in self.runs([self.load(t) for t in texts])]
        anchors, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        own = self.digests(names, texts)
        digest = list(own)
        of = np.array([int.from_bytes(d[:6], "little") % self.shards for d in digest], np.int64)
        same = {s: [(digest[i], own[digest[i]]) for i in at] for s, at in split_by(of, self.shards)}
        shard, low = self.keyed(anchors)
        sent = {s: (low[at][count[at] == 1], low[at][count[at] > 1]) for s, at in split_by(shard, self.shards)}
        none = np.zeros(0, np.uint32)
        for s in sorted({*same, *sent}):
            yield s, (*sent.get(s, (none, none)), same.get(s, []))

    def answer_first(self, asked):
        # one look-up for all buckets: their number grows with the corpus, so none may search what all of them hold
        each = [np.concatenate(m[:2]) for _, m in asked]
        _, at, count = np.unique(np.concatenate(each + [m[1] for _, m in asked]), return_inverse=True, return_counts=True)
        again = np.split((count > 1)[at], np.cumsum([len(own) for own in each]))
        least_of, seen = {}, {}
        for _, m in asked:
            for d, name in m[2]:
                least_of[d] = min(name, least_of.get(d, name))
                seen[d] = seen.get(d, 0) + 1
        for (b, m), own, more in zip(asked, each, again):
            yield b, (own[more], [(d, least_of[d]) for d, _ in m[2] if seen[d] > 1])

    def copies(self, names, texts, answers) -> list[bool]:
        """Which documents are later copies of a whole text (by sha256)."""
        own = self.digests(names, texts)
        for _, (_, same) in answers:
            own.update(same)
        return [len(t) >= self.window and own[hashlib.sha256(t).digest()] < n for n, t in zip(names.tolist(), texts)]

    def segments(self, names, texts, answers):
        """(doc, start, windows, shard, text) of candidate segments."""
        hits = np.sort(np.concatenate([(np.uint64(s) << np.uint64(32)) | a[0].astype(np.uint64) for s, a in answers]
                                      or [np.zeros(0, np.uint64)]))
        docs = [self.load(b"" if c else t) for t, c in zip(texts, self.copies(names, texts, answers))]
        found = []
        for doc, start, count, anchor in self.runs(docs):
            shard, low = self.keyed(anchor)
            key = (shard.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
            at = np.searchsorted(hits, key)
            hit = np.flatnonzero(hits[np.minimum(at, len(hits) - 1)] == key) if len(hits) else []
            for i, a, c, s in zip(doc[hit].tolist(), start[hit].tolist(), count[hit].tolist(), shard[hit].tolist()) if len(hit) else ():
                found.append((i, a, c, s, self.piece(docs[i], a, a + c - 1 + self.window)))
        return found

    def distinct(self, names, found):
        """Per shard: its distinct segments, sorted, with their first place."""
        out: dict[int, dict[bytes, tuple[int, int]]] = {}
        for i, a, _, s, text in found:
            place, at = self.place(int(names[i]), a), out.setdefault(s, {})
            if text not in at or place < at[text]:
                at[text] = place
        return {s: sorted(x.items()) for s, x in sorted(out.items())}

    def second(self, table, answers):
        """Each shard's segments, and where they stand here, which comes back with the answer."""
        names, texts = self.read(table)
        found = self.segments(names, texts, answers)
        stand: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for i, a, c, s, text in found:
            stand.setdefault(s, []).append((i, a, c, text))
        for s, segments in self.distinct(names, found).items():
            number = {t: j for j, (t, _) in enumerate(segments)}
            yield s, (np.array([len(t) for t, _ in segments], np.uint32), np.array([p for _, p in segments], np.int64),
                      b"".join(t for t, _ in segments), np.array([(i, a, c, number[t]) for i, a, c, t in stand[s]], np.uint32))

    def answer_second(self, asked):
        merged: dict[bytes, tuple[int, int]] = {}
        sent = []
        for b, (sizes, places, blob, stand) in asked:
            ends, own = np.cumsum(sizes).tolist(), []
            for size, end, p in zip(sizes.tolist(), ends, places.tolist()):
                t, p = blob[end - size:end], (p[0], p[1])
                if t not in merged or p < merged[t]:
                    merged[t] = p
                own.append(t)
            sent.append((b, own, stand))
        order = sorted(merged, key=merged.__getitem__)
        runs = dict(zip(order, self.repeated(order, np.array([merged[t] for t in order], np.int64))))
        for b, own, stand in sent:
            yield b, (np.array([merged[t] for t in own], np.int64),
                      np.array([(j, *r) for j, t in enumerate(own) for r in runs[t]], np.int32).reshape(-1, 3), stand)

    def finish(self, table, answers, answers2):
        names, texts = self.read(table)
        copy, docs = self.copies(names, texts, answers), [self.load(t) for t in texts]
        removed: list[list[tuple[int, int]]] = [[(0, len(d))] if c and len(d) >= self.window else [] for d, c in zip(docs, copy)]
        for _, (places, runs, stand) in answers2:
            cut = np.searchsorted(runs[:, 0], np.arange(len(places) + 1)).tolist()
            places, runs = places.tolist(), runs[:, 1:].tolist()
            for i, a, c, j in stand.tolist():
                if self.place(int(names[i]), a) > tuple(places[j]):
                    removed[i].append((a, a + c - 1 + self.window))
                elif cut[j] < cut[j + 1]:
                    removed[i] += [(a + x, a + y - 1 + self.window) for x, y in runs[cut[j]:cut[j + 1]]]
        return self.result([None if n == (1 << 63) - 1 else n for n in names.tolist()], texts, docs, [merge(r) for r in removed])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(length: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the merged spans leave of [0, length)."""
    ends = [0, *(b for _, b in spans)]
    return [(a, b) for a, b in zip(ends, [*(a for a, _ in spans), length]) if a < b]

"""Line dedup with a segment-partition edit join.

A line cut into threshold + 1 segments keeps one of them unchanged under ``threshold`` edits. So each line offers its
segments, keyed by its length and the segment's number, and asks for its own substrings at the places where a segment of a
line of its length or a little less could have moved. First round: keys that different lines share, and where each line first occurs. Second
round: lines with such keys meet in the key's shard, and candidates are verified by a bit-parallel edit distance in a band of
2 * threshold + 1 diagonals, many pairs at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.common import encode, ids, split_by, two_rounds

EDITS = 2
LEAST = 30  # shorter lines (bytes) have no near match
PAIRS = 1 << 17  # verified at a time
CELLS = 1 << 24  # bytes of padded lines held at a time


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of each of edits + 1 segments of about equal size."""
    size, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = size + (i > edits - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(length of the other line, segment, start, size) of the substrings to look up for lines of the same length or shorter.

    Segment i can have moved by i at most, seen from the left, and by edits - i, seen from the right.
    """
    out = []
    for less in range(edits + 1):
        if length - less > edits:
            for i, (p, n) in enumerate(segments(length - less, edits)):
                for q in range(max(0, p - i, p + less - edits + i), min(length - n, p + i, p + less + edits - i) + 1):
                    out.append((length - less, i, q, n))
    return out


_plans: dict[tuple[int, int], tuple] = {}


def keys(line: bytes, edits: int) -> tuple[list[int], list[int]]:
    """64-bit keys of the segments it offers and of the substrings it asks for."""
    plan = _plans.get((len(line), edits))
    if plan is None:
        n = len(line)
        plan = _plans[n, edits] = ([(n * 16 + i, p, p + s) for i, (p, s) in enumerate(segments(n, edits))],
                                   [(m * 16 + i, q, q + s) for m, i, q, s in probes(n, edits)])
        if len(_plans) > 20_000:
            _plans.clear()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], k) for k, a, b in plan[0]], [digest(line[a:b], k) for k, a, b in plan[1]]


def within(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, edits: int) -> np.ndarray:
    """Whether each row of ``a`` is at ``edits`` edits or fewer from the same row of ``b`` (padded bytes).

    Bit o of state[e] says that some way of e edits has used j bytes of a and j + o - edits bytes of b. One step uses
    a byte of a: a match keeps the diagonal, a substitution too at one edit more, a deletion moves one down, and an insertion
    one up.
    """
    n, width = a.shape
    full = (1 << (2 * edits + 1)) - 1
    state = [np.zeros(n, np.uint16) for _ in range(edits + 1)]
    for e in range(edits + 1):
        for up in range(e + 1):
            state[e] |= np.uint16(1 << (edits + up))
    padded = np.zeros((width + 2 * edits + 1, n), np.uint8)
    padded[edits:edits + min(b.shape[1], width + edits + 1)] = b.T[:width + edits + 1]
    columns = np.ascontiguousarray(a.T)
    ok = np.zeros(n, bool)
    goal = np.left_shift(1, np.clip(b_size - a_size + edits, 0, 15)).astype(np.uint16)
    near = np.abs(a_size.astype(np.int64) - b_size) <= edits
    ends = np.argsort(a_size, kind="stable")
    cut = np.searchsorted(a_size[ends], np.arange(width + 2))
    ok[(a_size == 0) & near] = True
    for j in range(width):
        same = np.zeros(n, np.uint16)
        for o in range(2 * edits + 1):
            # beyond the end of b nothing matches
            same |= ((padded[j + o] == columns[j]) & (j + o - edits < b_size) & (j + o >= edits)).astype(np.uint16) << np.uint16(o)
        old, before = state, None
        state = []
        for e in range(edits + 1):
            s = old[e] & same
            if e:
                s = s | old[e - 1] | (old[e - 1] >> np.uint16(1)) | ((before << np.uint16(1)) & np.uint16(full))
            state.append(s)
            before = s
        done = ends[cut[j + 1]:cut[j + 2]]
        ok[done] = (state[edits][done] & goal[done]) != 0
    return ok & near


def _counts(lines: list[bytes], bins: int = 16) -> np.ndarray:
    """How often each line holds bytes of each remainder; an edit changes two of the counts by one at most."""
    size = np.array([len(t) for t in lines], np.int64)
    at = np.repeat(np.arange(len(lines)), size) * bins + (np.frombuffer(b"".join(lines), np.uint8) % bins)
    return np.bincount(at, minlength=len(lines) * bins).reshape(-1, bins).astype(np.int32)


def _cores(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """The two without the beginning and the end that they share, which cost no edits."""
    for back in (False, True):
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:  # longest shared beginning (end), by halving
            m = (lo + hi + 1) // 2
            if (a[-m:] == b[-m:]) if back else (a[:m] == b[:m]):
                lo = m
            else:
                hi = m - 1
        if lo:
            a, b = (a[:-lo], b[:-lo]) if back else (a[lo:], b[lo:])
    return a, b


def _pad(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in lines], np.int64)
    width = int(size.max())
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in lines), np.uint8).reshape(len(lines), width), size


def _verify(lines: list[bytes], counts: np.ndarray, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """``within`` for pairs of line numbers, in batches of similar length, where the byte counts allow it."""
    out = np.zeros(len(x), bool)
    may = np.flatnonzero(np.abs(counts[x] - counts[y]).sum(1) <= 2 * edits)
    if not len(may):
        return out
    cores = [_cores(lines[i], lines[j]) for i, j in zip(x[may].tolist(), y[may].tolist())]
    size = np.array([max(len(a), len(b)) for a, b in cores])
    out[may[size <= edits]] = True  # so short a rest can be replaced
    order = np.argsort(size, kind="stable")
    order = order[size[order] > edits]
    a = 0
    while a < len(order):
        most = max(1, min(PAIRS, CELLS // int(size[order[a]] * 2 + 64)))
        b = min(a + most, int(np.searchsorted(size[order], size[order[a]] * 2 + 32, "right")))
        part = order[a:b]
        left, right = zip(*(cores[i] for i in part))
        out[may[part]] = within(*_pad(left), *_pad(right), edits)
        a = b
    return out


def earlier_near(lines: list[bytes], places: list[tuple], key: np.ndarray, line: np.ndarray, offers: np.ndarray, edits: int) -> np.ndarray:
    """Which lines have an earlier line within the edits among those they share a key with.

    Every line goes through the earlier entries of its keys in order, twice as many in each turn, and stops at the first near one; so
    a group of lines that are all alike costs one comparison each.
    """
    rank = np.empty(len(lines), np.int64)
    rank[sorted(range(len(lines)), key=places.__getitem__)] = np.arange(len(lines))
    order = np.lexsort((rank[line], key))
    key, line, offers = key[order], line[order], offers[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    depth = np.arange(len(key)) - start
    near = np.zeros(len(lines), bool)
    counts = _counts(lines)
    lo, step = 0, 1
    active = np.arange(len(key))
    while len(active := active[(depth[active] > lo) & ~near[line[active]]]):
        for a in range(0, len(active), max(1, PAIRS // step)):
            own = active[a:a + max(1, PAIRS // step)]
            own = own[~near[line[own]]]
            count = np.minimum(depth[own] - lo, step)
            entry = np.repeat(own, count)
            other = start[entry] + lo + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
            fits = (line[entry] != line[other]) & (offers[entry] != offers[other])
            pair = np.unique(line[entry[fits]] * len(lines) + line[other[fits]])
            x, y = pair // len(lines), pair % len(lines)
            if len(x):
                near[x[_verify(lines, counts, x, y, edits)]] = True
        lo, step = lo + step, step * 2
    return near


class _Lines:
    shards = 1
    empty = None

    def __init__(self, edits: int, least: int, exact: int):
        self.edits, self.least, self.exact = edits, least, exact

    def read(self, table):
        names, texts = ids(table["doc_id"]), [t.split(b"\n") for t in encode(table)]
        first: dict[bytes, tuple[int, int]] = {}
        for name, lines in zip(names.tolist(), texts):
            for i, t in enumerate(lines):
                if len(t) >= self.exact and (name, i) < first.get(t, (1 << 63, 0)):
                    first[t] = (name, i)
        return names, texts, dict(sorted(first.items()))

    def keyed(self, line: bytes):
        """Shard, low half, line hash and role of the line's keys."""
        offer, ask = keys(line, self.edits)
        return offer + ask, [True] * len(offer) + [False] * len(ask)

    def entries(self, lines):
        key, of, role = [], [], []
        for j, t in enumerate(lines):
            k, r = self.keyed(t)
            key += k
            role += r
            of += [j] * len(k)
        key = np.array(key, np.uint64)
        return ((key >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64), key.astype(np.uint32), np.array(of, np.int64), np.array(role, bool)

    def first(self, table):
        _, _, first = self.read(table)
        digest = [xxhash.xxh128_digest(t) for t in first]
        place = list(first.values())
        at = np.array([int.from_bytes(d[:6], "little") % self.shards for d in digest], np.int64)
        seen = {s: ([digest[i] for i in own], [place[i] for i in own]) for s, own in split_by(at, self.shards)}
        long = [i for i, t in enumerate(first) if len(t) >= self.least]
        shard, key, of, role = self.entries([t for t in first if len(t) >= self.least])
        short = np.array([int.from_bytes(digest[i][8:12], "little") for i in long], np.uint32)
        sent = {s: (key[own], short[of[own]], role[own]) for s, own in split_by(shard, self.shards)}
        none = (np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, bool))
        for s in sorted({*seen, *sent}):
            yield s, (*sent.get(s, none), *seen.get(s, ([], [])))

    def answer_first(self, asked):
        key, short, role = (np.concatenate([m[i] for _, m in asked]) for i in range(3))
        pair = np.unique((key.astype(np.uint64) << np.uint64(32)) | short)
        own, count = np.unique(pair >> np.uint64(32), return_counts=True)
        live = np.intersect1d(own[count > 1].astype(np.uint32), key[role])
        least: dict[bytes, tuple[int, int]] = {}
        for _, m in asked:
            for d, p in zip(m[3], m[4]):
                if d not in least or p < least[d]:
                    least[d] = p
        for b, m in asked:
            yield b, (np.intersect1d(m[0], live), [d for d, p in zip(m[3], m[4]) if least[d] < p])

    def later(self, answers) -> set[bytes]:
        return {d for _, (_, found) in answers for d in found}

    def second(self, table, answers):
        _, _, first = self.read(table)
        later = self.later(answers)
        own = [(t, p) for t, p in first.items() if len(t) >= self.least and xxhash.xxh128_digest(t) not in later]
        shard, key, of, role = self.entries([t for t, _ in own])
        live = np.sort(np.concatenate([(np.uint64(s) << np.uint64(32)) | a[0].astype(np.uint64) for s, a in answers] or [np.zeros(0, np.uint64)]))
        wide = (shard.astype(np.uint64) << np.uint64(32)) | key
        hit = np.flatnonzero(np.isin(wide, live))
        for s, at in split_by(shard[hit], self.shards):
            at = hit[at]
            used, number = np.unique(of[at], return_inverse=True)
            yield s, ([own[j][0] for j in used], [own[j][1] for j in used], key[at], number, role[at])

    def answer_second(self, asked):
        lines, places, key, line, role = [], [], [], [], []
        for _, (t, p, k, n, r) in asked:
            key.append(k)
            line.append(n + len(lines))
            role.append(r)
            lines += t
            places += p
        near = earlier_near(lines, places, *(np.concatenate(x) for x in (key, line, role)), self.edits)
        at = 0
        for b, (t, *_) in asked:
            yield b, [xxhash.xxh128_digest(x) for x, bad in zip(t, near[at:at + len(t)]) if bad]
            at += len(t)

    def finish(self, table, answers, answers2):
        names, texts, first = self.read(table)
        later, near = self.later(answers), {d for _, found in answers2 for d in found}
        gone = {t: (d := xxhash.xxh128_digest(t)) in later or d in near for t in first}
        kept, total, removed = [], [], []
        for name, lines in zip(names.tolist(), texts):
            left = [t for i, t in enumerate(lines) if len(t) < self.exact or (first[t] == (name, i) and not gone[t])]
            kept.append(b"\n".join(left).decode())
            total.append(len(lines))
            removed.append(len(lines) - len(left))
        out = table.drop_columns(["__b"]).set_column(table.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
        return out.append_column("__lines", pa.array(total, pa.int64())).append_column("__removed", pa.array(removed, pa.int64()))


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, lines: str | None = None, removed: str | None = None,
               exact: int | None = None) -> DataFrame:
    """``docs`` with every repeated or nearly repeated line cut from ``text``, all other columns unchanged, one row per row.

    A line of at least ``least`` UTF-8 bytes goes if an equal line, or one within ``edits`` byte edits, occurs before it (smaller
    doc_id, or the same document and an earlier line); one of at least ``exact`` bytes (default ``least``) goes if an equal line does.
    An empty line stays unless ``exact`` is 0. Lines are judged on the input and split at "\\n" only. ``lines`` and ``removed`` name
    columns for the counts. A null text becomes empty (one empty line); a null doc_id counts as larger than all others; rows with one doc_id
    are one document, so equal lines at equal places in them stay; an empty table gives no rows; columns of other
    names pass through.
    """
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", `__lines` bigint, `__removed` bigint"
    out = two_rounds(rows, _Lines(edits, least, least if exact is None else exact), schema)
    for new, old in ((lines, "__lines"), (removed, "__removed")):
        out = out.withColumnRenamed(old, new) if new else out.drop(old)
    return out


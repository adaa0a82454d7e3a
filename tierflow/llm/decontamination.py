"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of canonical tokens of the benchmark are looked up by the
hashes of their beginnings, one token more at a time, their tokens compared, and the values in the slots must map one to
one, so that a question with other numbers or names in it is found and a chance likeness is not. A capitalised word is
looked up both as a name and as the word that it is.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.common import held
from tierflow.llm.tokens import _Numbers, balanced, _room

WINDOW = 10
PLAIN = 5  # a window with fewer tokens that are no slots (or all but one of a short item) must be an exact copy or the whole item
LEAST = 4  # a shorter item can't be told from chance
BLOCK_BYTES = 8 << 20  # benchmark text looked up in one pass
BATCH_BYTES = 1 << 20
MEMO = 1_000_000

# Words that stand for a number, and units that may follow one.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
UNITS = """mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs
pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr
hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre
kilometres mph kmh percent degree degrees dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz kb mb gb tb
w kw v kv a n j kj cal kcal % $ € £ °""".split()

# Scripts without spaces are cut into characters: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\U00020000-\\U0003ffff"
_LETTER = rf"[^\W\d_{_UNSPACED}]"
_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|{_LETTER}+(?:['’]{_LETTER}+)*|(?![\d_])(?=\w)[{_UNSPACED}]|[.!?:;\n]|[%$€£°]"
                    r"|(?<=[\d)\s])[-+*/=<>^×÷−](?=\s*[\d(])")
OTHER, STOP, NUMBER, TITLE, UNIT = range(5)
_SLOT_HASH = np.array([0, 0, *(0x9E3779B97F4A7C15 * k % 2**64 for k in (3, 5, 7))], np.uint64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_number_words, _units = frozenset(NUMBER_WORDS), frozenset(UNITS)


def _kind(token: str) -> int:
    low = token.lower()
    if token in ".!?:;\n":
        return STOP
    if token[0].isdigit() or low in _number_words:
        return NUMBER
    if low in _units:
        return UNIT
    return TITLE if token[0].isupper() and len(token) > 1 and token[1:].islower() else OTHER


class _Canon:
    """Tokens of texts in a row; kinds and hashes of words are looked up."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.at, self.kind, self.hash = _Numbers(), np.zeros(1024, np.int8), np.zeros(1024, np.uint64)

    def read(self, texts: list[str]):
        """Without sentence ends: tokens, kind in context, whether a sentence begins, hash as a word or slot, where each text begins.

        A title's hash is that of the word.
        """
        if len(self.at) > MEMO:
            self._forget()
        cut = [_TOKEN.findall(t) for t in texts]
        size = np.array([len(c) for c in cut], np.int64)
        tokens = list(chain.from_iterable(cut))
        self.at.new = []
        at = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        if new := self.at.new:
            n = len(self.at)
            self.kind, self.hash = _room(self.kind, n), _room(self.hash, n)
            self.kind[n - len(new):n] = [_kind(t) for t in new]
            self.hash[n - len(new):n] = [zlib.crc32(b := t.lower().encode()) << 32 | zlib.crc32(b"+" + b) for t in new]
        kind = self.kind[at]
        first = np.zeros(len(kind), bool)
        begin = np.cumsum(size) - size
        first[begin[size > 0]] = True
        after = np.concatenate([[STOP], kind[:-1]]) if len(kind) else kind
        after = np.where(first, STOP, after)
        kind = np.where((kind == UNIT) & (after != NUMBER), OTHER, kind)
        stay = np.flatnonzero(kind != STOP)
        own = np.where((kind == NUMBER) | (kind == UNIT), _SLOT_HASH[kind], self.hash[at])[stay]
        ends = np.searchsorted(stay, np.concatenate([begin, [len(kind)]]))
        return [tokens[i] for i in stay.tolist()], kind[stay], (after == STOP)[stay], own, ends


def _value(token: str, kind: int) -> str:
    return token.replace(",", "") if kind == NUMBER else token


def consistent(pairs: set[tuple[str, str]]) -> bool:
    """Slot values correspond one to one."""
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _longer(h: np.ndarray, at: np.ndarray, own: np.ndarray, kind: np.ndarray):
    """Hashes of beginnings that take in the token at ``at``, and which of them they continue: a title as a word and as a name."""
    h = h * _MIX
    title = np.flatnonzero(kind[at] == TITLE)
    return np.concatenate([h ^ own[at], h[title] ^ _SLOT_HASH[TITLE]]), np.concatenate([np.arange(len(h)), title])


class _Hashes:
    """A set of hashes; a table of bits is asked first."""

    def __init__(self, h: np.ndarray):
        self.sorted = np.unique(h)
        self.shift = np.uint64(64 - max(18, (8 * len(h)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self._at(self.sorted)] = True

    def _at(self, h):
        return ((h * _MIX) >> self.shift).astype(np.int64)

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` that are in the set."""
        at = np.flatnonzero(self.seen[self._at(h)])
        return at[self.sorted[np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)] == h[at]]


class Index:
    """Windows of some benchmark items, by the hashes of their beginnings."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.canon = _Canon()
        self.tokens, self.kind, self.opens, own, ends = self.canon.read([t for _, t in items])
        self.low = [t.lower() for t in self.tokens]
        size = np.diff(ends)
        n = np.minimum(window, size)
        self.count = np.where(size < LEAST, 0, size - n + 1)  # windows of each item
        of = np.repeat(np.arange(len(items)), self.count)
        self.of, self.n = of, n[of]
        self.start = ends[of] + np.arange(len(of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.ends, self.ids = ends, [i for i, _ in items]
        self.begins: list[_Hashes] = []
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []  # hashes of windows of this length, and the windows
        own_window, h = np.arange(len(of)), np.zeros(len(of), np.uint64)
        while len(own_window):
            j = len(self.begins)
            h, go = _longer(h, self.start[own_window] + j, own, self.kind)
            own_window = own_window[go]
            self.begins.append(_Hashes(h))
            full = self.n[own_window] == j + 1
            order = np.argsort(h[full], kind="stable")
            self.whole.append((h[full][order], own_window[full][order]))
            h, own_window = h[~full], own_window[~full]

    def _compare(self, w: int, tokens, kind, opens, i: int):
        """None, or of a window and the tokens at i: plain tokens, words among them, slot values, and those and whether all else
        is equal where words that begin a sentence are no names."""
        plain = words = 0
        pairs, inner, equal = [], [], True
        for x in range(int(self.n[w])):
            a, b = int(self.start[w]) + x, i + x
            ka, kb, ta, tb = self.kind[a], kind[b], self.low[a], tokens[b].lower()
            if ka == kb and ka >= NUMBER:
                pair = (_value(ta, ka), _value(tb, kb))
                pairs.append(pair)
                if ka != TITLE:
                    inner.append(pair)
                    continue
                if self.opens[a] or opens[b]:
                    equal &= ta == tb
                else:
                    inner.append(pair)
                if ta != tb:
                    continue
            elif ta != tb or NUMBER in (ka, kb) or UNIT in (ka, kb):
                return None
            plain += 1
            words += ta[0].isalpha()
        return plain, words, tuple(pairs), tuple(inner) if equal else None

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(item, first token, end token) of each text's matching windows.

        Windows on one diagonal must agree on the slots together, with words that begin sentences as names or as plain words; a
        window with equal slots always counts. One with few plain tokens counts if its slots are equal, or if the whole item
        is there and has a word.
        """
        tokens, kind, opens, own, ends = self.canon.read(texts)
        runs: dict[tuple[int, int, int], dict] = {}  # windows of one document and item on one diagonal
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        pos, h = np.arange(len(own)), np.zeros(len(own), np.uint64)
        for j, (begins, (full, window)) in enumerate(zip(self.begins, self.whole)):
            inside = np.flatnonzero(pos + j < ends[doc[pos] + 1]) if len(pos) else pos
            h, go = _longer(h[inside], pos[inside] + j, own, kind)
            pos = pos[inside][go]
            near = begins.among(h)
            pos, h = pos[near], h[near]
            a, b = np.searchsorted(full, h), np.searchsorted(full, h, "right")
            for k in np.flatnonzero(b > a).tolist():
                i = int(pos[k])
                d = int(doc[i])
                for w in window[a[k]:b[k]].tolist():
                    item = int(self.of[w])
                    run = runs.setdefault((d, item, i - int(self.start[w] - self.ends[item])), {})
                    if i not in run:
                        run[i] = (j + 1, self._compare(w, tokens, kind, opens, i))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (d, item, _), run in sorted(runs.items()):
            found = [(i, n, *c) for i, (n, c) in sorted(run.items()) if c]
            names = consistent({p for *_, pairs, _ in found for p in pairs})
            inner = consistent({p for *_, x in found for p in x or ()})
            whole = names and len(found) == self.count[item] and any(words for _, _, _, words, *_ in found)
            for i, n, plain, _, pairs, plainly in found:
                equal = all(x == y for x, y in pairs)
                if equal and (plain or len(found) == self.count[item]) or whole or plain >= min(PLAIN, n - 1) and (names or inner and plainly is not None):
                    out[d].append((self.ids[item], i - int(ends[d]), i - int(ends[d]) + n))
        return out


def _index(name: str, items, window: int) -> Index:
    built = held("decontamination", dict)
    if (name, window) not in built:
        built[name, window] = Index(items, window)
    return built[name, window]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items, in blocks of about ``block_bytes`` of text; each block is looked up in a pass of its own."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows.collect())


def _blocks(benchmark: DataFrame, block_bytes: int):
    for items in benchmark_blocks(benchmark, block_bytes):
        yield f"{zlib.crc32(repr(items).encode())}-{len(items)}", items


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _found(name, items, window, column: pa.Array):
    index, texts, out = _index(name, items, window), _texts(column), []
    for a, b in balanced([len(t) for t in texts], BATCH_BYTES):
        out += index.hits(texts[a:b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, hits (item_id, first and end token of each window that matches), one row per row of ``docs``.

    Tokens are numbers, words (characters in scripts without spaces), unit signs, and operators before numbers; a capitalised word may be
    a name, a unit follows a number. Windows have ``window`` tokens, or all of a shorter item (items under 4 tokens are never found); those
    with fewer than 5 plain tokens (or n - 1 of n) must be exact copies, or the whole item must be there. The benchmark is held in blocks of bounded size on
    every executor, one pass each, so ``docs`` is not shuffled. A null text is empty and clean; a null doc_id stays null; repeated rows are judged
    each; an empty table gives no rows, an empty benchmark no hits; other columns are ignored.
    """
    from tierflow.llm.common import doc_rows
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    out = doc_rows(docs).withColumn("hits", F.array().cast("array<struct<item_id:bigint,start:bigint,end:bigint>>"))

    def passed(name, items):
        def go(batches):
            for b in batches:
                own = [x + [{"item_id": i, "start": a, "end": e} for i, a, e in y]
                       for x, y in zip(b["hits"].to_pylist(), _found(name, items, window, b["text"]))]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(own, hit)], ["doc_id", "text", "hits"])
        return go

    for name, items in _blocks(benchmark, block_bytes):
        out = out.mapInArrow(passed(name, items), out.schema)
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), "hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    def passed(name, items):
        def go(batches):
            for b in batches:
                yield b.filter(pa.array([not h for h in _found(name, items, window, b["text"])], pa.bool_()))
        return go

    out = docs
    for name, items in _blocks(benchmark, block_bytes):
        out = out.mapInArrow(passed(name, items), out.schema)
    return out

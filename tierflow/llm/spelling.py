"""Spelling variants: words one edit apart, found by asking Bloom filters about generated edits.

Every word's edits are asked of blocked Bloom filters of the vocabulary, one shard for each word length. The filters are broadcast and
have a fixed size at most; a larger vocabulary is asked part by part. Only edits that a filter may hold are shuffled to the
exact join with the vocabulary, which drops the false ones. Deletions find insertions from the other side, and a replacement
is asked from the word with the smaller letter, so each pair comes up once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tierflow.operators.scale import staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS = 6
LEAST_COUNT = 5
SLIP = 199  # one run in so many loses a letter
TIMES = 5  # a form occurs so many times as often as its variant, or more
FILTER_BYTES = 32 << 20  # largest filter that is broadcast
WORD_BITS = 24  # filter bits a word
LONGEST = 64  # longer words share the shard of this length
PROBES = 1 << 20  # edits asked at a time
COUNTED = 500_000  # distinct words a task counts before it hands them on
SEGMENT = 1 << 13  # 64-bit blocks that are filled together

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(a: int, b: int) -> np.ndarray:
    out = np.full(b - a, _STEP, np.uint64)
    out[0] = pow(_STEP, a, 1 << 64)
    return np.multiply.accumulate(out)


def slip(doc_id: int | None, word: str, one_in: int = SLIP) -> str:
    """The lower-cased run as counted: where crc32 of "<doc_id>:<run>" is a multiple of ``one_in``, without the letter that the crc names."""
    return _slip(zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), word, one_in)


def _slip(start: int, word: str, one_in: int) -> str:
    h = zlib.crc32(word.encode(), start)
    if h % one_in:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def word_counts(docs: DataFrame, one_in: int = SLIP) -> DataFrame:
    """(word, n) over all documents; tasks add up what they read before the shuffle."""
    def go(batches):
        counts: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(raw.translate(_LOWER).decode(errors="replace"))).items():
                    if zlib.crc32(word.encode(), start) % one_in == 0:
                        word = _slip(start, word, one_in)
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield out()
                    counts = {}
        yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(go, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str]):
    """(rows, matrix of their Latin-1 letters) for each word length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), int(n))


def _place(h: np.ndarray, length: int, shards: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Block of the filter, within the shard of the word's length, and the bits that the word sets there."""
    first, blocks = shards[min(length, LONGEST)]
    h = _mix(h)
    block = np.uint64(first) + (h >> np.uint64(32)) * np.uint64(blocks) // np.uint64(1 << 32)
    bits = np.uint64(1) << (h & np.uint64(63))
    for k in (6, 12, 18, 24):
        bits |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
    return block, bits


def _hash(m: np.ndarray) -> np.ndarray:
    h = np.zeros(len(m), np.uint64)
    for a in range(0, m.shape[1], LONGEST):
        part = m[:, a:a + LONGEST]
        h += (_LETTER[part] * _powers(a, a + part.shape[1])).sum(1, dtype=np.uint64)
    return h


def _filter(words: DataFrame, shards: dict, blocks: int) -> np.ndarray:
    """The filter of ``words``, filled in segments by tasks."""
    def places(batches):
        for batch in batches:
            own = batch["word"].to_pylist()
            for at, m in _letters(own):
                block, bits = _place(_hash(m), m.shape[1], shards)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(bits.view(np.int64))], ["block", "bits"])

    def fill(key, table):
        part = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(part, table["block"].to_numpy() % SEGMENT, table["bits"].to_numpy().view(np.uint64))
        return pa.table({"segment": [key[0].as_py()], "bits": [part.tobytes()]}, schema=pa.schema([("segment", pa.int64()), ("bits", pa.binary())]))

    filled = (words.select("word").mapInArrow(places, "block bigint, bits bigint").withColumn("segment", F.floor(F.col("block") / SEGMENT))
              .groupBy("segment").applyInArrow(fill, "segment bigint, bits binary"))
    out = np.zeros(-(-blocks // SEGMENT) * SEGMENT, np.uint64)
    for r in filled.toLocalIterator():  # at most FILTER_BYTES together
        out[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = np.frombuffer(r["bits"], np.uint64)
    return out


def _edits(m: np.ndarray, alphabet: np.ndarray, bloom: np.ndarray, shards: dict):
    """(row, edited words as a matrix) for the edits of the words in ``m`` that the filter may hold."""
    n, length = m.shape
    total = _hash(m)
    width = max(1, min(length, PROBES // max(1, n * len(alphabet))))
    shorter, same = min(length - 1, LONGEST) in shards, min(length, LONGEST) in shards
    before = np.zeros(n, np.uint64)
    for a in range(0, length, width):
        part = m[:, a:a + width]
        power = _powers(a, a + part.shape[1])
        term = _LETTER[part] * power
        upto = np.cumsum(term, 1, dtype=np.uint64) + before[:, None]
        if shorter:
            block, bits = _place(upto - term + (total[:, None] - upto) * _BACK, length - 1, shards)
            after = np.full(part.shape, 256, np.int64)  # of equal letters in a row, the last is taken out
            rest = m[:, a + 1:a + 1 + width]
            after[:, :rest.shape[1]] = rest
            row, i = np.nonzero((part != after) & (bloom[block] & bits == bits))
            for b in range(0, len(row), max(1, PROBES // length)):
                r, p = row[b:b + max(1, PROBES // length)], i[b:b + max(1, PROBES // length)] + a
                yield r, m[r][np.arange(length) != p[:, None]].reshape(len(r), length - 1)
        if same:
            block, bits = _place((total[:, None] - term)[:, :, None] + power[None, :, None] * _LETTER[alphabet], length, shards)
            row, i, k = np.nonzero((alphabet > part[:, :, None]) & (bloom[block] & bits == bits))
            for b in range(0, len(row), max(1, PROBES // length)):
                cut = slice(b, b + max(1, PROBES // length))
                out = m[row[cut]]
                out[np.arange(len(out)), i[cut] + a] = alphabet[k[cut]]
                yield row[cut], out
        before = upto[:, -1]


def candidates(words: DataFrame, asked: DataFrame, shards: dict, blocks: int, alphabet: np.ndarray) -> DataFrame:
    """(word, n, near): edits of ``words`` that the filter of ``asked`` may hold."""
    bloom = words.sparkSession.sparkContext.broadcast(_filter(asked, shards, blocks))

    def go(batches):
        for batch in batches:
            own, counts = batch["word"].to_pylist(), batch["n"]
            for at, m in _letters(own):
                step = max(1, PROBES // (m.shape[1] * max(1, len(alphabet))))
                for b in range(0, len(at), step):
                    for row, near in _edits(m[b:b + step], alphabet, bloom.value, shards):
                        if len(row):
                            index = pa.array(at[b:b + step][row])
                            text = near.tobytes().decode("latin-1")
                            k = near.shape[1]
                            yield pa.RecordBatch.from_arrays(
                                [batch["word"].take(index), counts.take(index), pa.array([text[j:j + k] for j in range(0, len(text), k)], pa.string())],
                                ["word", "n", "near"])

    return words.mapInArrow(go, "word string, n bigint, near string")


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): each pair of ``words`` (word, n; distinct runs of letters) one edit apart, once.

    The filters hold WORD_BITS bits a word and ``filter_bytes`` at most; more words than that are asked in parts by a hash. An empty
    table gives no rows.
    """
    most = max(1, filter_bytes * 8 // WORD_BITS // 2)  # parts by a hash aren't equal
    parts = max(1, -(-words.count() // most))
    numbered = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    counts = numbered.groupBy("part", F.least(F.char_length("word"), F.lit(LONGEST)).alias("length")).count().collect()
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "(?!^)")))).distinct().collect() if r[0]), np.uint8)
    out = None
    for part in range(parts):
        shards, blocks = {}, 0
        for r in sorted((r for r in counts if r["part"] == part), key=lambda r: r["length"]):
            size = -(-r["count"] * WORD_BITS // 64)
            shards[r["length"]] = (blocks, size)
            blocks += size
        if not blocks:
            continue
        found = candidates(words, numbered.where(F.col("part") == part), shards, blocks, alphabet)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    return out.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last one, twice as far in each round."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES,
                      one_in: int = SLIP, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    Words are runs of Latin letters, with A-Z lower-cased and after ``slip``, of at least ``least_chars`` code points that occur at least
    ``least_count`` times. A word's form is its near word (exactly one edit apart) with the largest n, of equal ones the first in code-point order, if
    that is at least ``times`` the word's n. A null or empty text has no words, a null doc_id counts as an empty one in ``slip``; repeated rows
    count each; invalid UTF-8 ends a run; an empty table gives no rows; other columns are ignored.
    """
    words = staged(word_counts(docs, one_in).where((F.char_length("word") >= least_chars) & (F.col("n") >= least_count)))
    pairs = near_words(words, filter_bytes)
    # every pair seen from both of its words
    seen = pairs.select(F.explode(F.array(F.struct("word", "near", F.col("near_n").alias("m")),
                                          F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("m")))).alias("p")).select("p.*")
    best = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    formed = staged(words.join(best, "word", "left")
                    .withColumn("chosen", F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False)))
                    .select("word", F.when(F.col("chosen"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                            F.when(F.col("chosen"), -F.col("best.m")).alias("form_n")))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

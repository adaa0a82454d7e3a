"""Statistics of whole texts, a block of texts at a time: code points are classed by a table and counted per text and per word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.tokens import balanced

BLOCK_CHARS = 1 << 20

#: What is counted, by the pattern that it matches, and what it is a share of. The first four: characters left when the pattern is taken out.
CLASSES = {"letter_share": (r"\P{L}+", "chars"), "upper_share": (r"\P{Lu}+", "letters"), "digit_share": (r"\P{Nd}+", "chars"),
           "symbol_share": (r"[\p{L}\p{Nd}\s.,]+", "chars")}
MATCHES = {
    "symbol_run_share": (r"([^\p{L}\p{Nd}\s])\1+", "words"),
    "comma_share": (r"\p{L},", "words"),
    "stop_share": (r"\p{L}[.?!](?!\S)", "words"),
    "plain_word_share": (r"(?<!\S)\p{L}++[.,;:?!]?(?!\S)", "words"),
    "short_word_share": (r"(?<!\S)\S{1,2}(?!\S)", "words"),
    "long_word_share": (r"(?<!\S)\S{16}", "words"),
    "repeated_word_share": (r"(?<!\S)(\S++)\s+(?=\1(?!\S))", "words"),
    "line_share": (r"\n", "words"),
    "capital_word_share": (r"(?<!\S)\p{Lu}\p{Ll}*+(?!\S)", "words"),
    "bare_number_share": (r"(?<!\S)\p{Nd}++(?!\S)", "words"),
}
STATISTICS = ("log_chars", "word_chars", *CLASSES, *MATCHES)

_UPPER, _LOWER, _OTHER, _DIGIT, _SPACE, _STOP, _TAIL = (np.uint8(1 << i) for i in range(7))
_LETTER = _UPPER | _LOWER | _OTHER


@lru_cache(1)
def _classes() -> np.ndarray:
    """The classes of every code point; whitespace is that of ASCII."""
    kinds = {"Lu": _UPPER, "Ll": _LOWER, "Lt": _OTHER, "Lm": _OTHER, "Lo": _OTHER, "Nd": _DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), np.uint8, 0x110000)
    for chars, kind in ((" \t\n\x0b\f\r", _SPACE), (".?!", _STOP), (".,;:?!", _TAIL)):
        out[[ord(c) for c in chars]] |= kind
    return out


def _same_as_next(codes, start, size) -> np.ndarray:
    """Of words by start and size, which equal the one after them; the last has none."""
    out = np.zeros(len(start), bool)
    end = start + size - 1
    maybe = np.flatnonzero((size[:-1] == size[1:]) & (codes[start[:-1]] == codes[start[1:]]) & (codes[end[:-1]] == codes[end[1:]]))
    if len(maybe):
        n = size[maybe]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        differs = codes[np.repeat(start[maybe], n) + step] != codes[np.repeat(start[maybe + 1], n) + step]
        out[maybe] = ~np.logical_or.reduceat(differs, first)
    return out


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """chars, words, and the counts of CLASSES and MATCHES, for every text."""
    n = len(texts)
    # every text ends with a line break of its own, so words and runs end with it and no text is without characters
    codes = np.frombuffer(("\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), "<u4")
    chars = np.fromiter(map(len, texts), np.int64, n)
    begin = np.cumsum(chars + 1) - chars - 1
    kind = _classes()[codes]
    letter, space = (kind & _LETTER) != 0, (kind & _SPACE) != 0

    def of_texts(mask):
        return np.add.reduceat(mask[:-1], begin, dtype=np.int64)

    sign = (kind & (_LETTER | _DIGIT | _SPACE)) == 0
    comma, digit = codes == 44, (kind & _DIGIT) != 0
    again = np.append(sign[:-1] & (codes[1:] == codes[:-1]), False)  # a sign that stands once more after itself
    run = again.copy()
    run[1:] &= ~again[:-1]
    stop = np.zeros_like(letter)
    stop[:-2] = letter[:-2] & ((kind[1:-1] & _STOP) != 0) & space[2:]
    out = {"chars": chars, "letter_share": of_texts(letter), "upper_share": of_texts((kind & _UPPER) != 0), "digit_share": of_texts(digit),
           "symbol_share": of_texts(sign & ~comma & (codes != 46)), "symbol_run_share": of_texts(run),
           "comma_share": of_texts(np.append(letter[:-1] & comma[1:], False)), "stop_share": of_texts(stop),
           "line_share": of_texts(codes == 10) - 1}

    edge = np.flatnonzero(np.diff(space, prepend=True))  # words and gaps take turns, a word first and a gap last
    start, size = edge[::2], edge[1::2] - edge[::2]
    text = np.searchsorted(begin, start, "right") - 1

    def of_words(mask):
        return np.bincount(text[mask], minlength=n)

    words = np.bincount(text, minlength=n)
    if len(start):
        letters, lowers, digits = (np.add.reduceat(m, start, dtype=np.int64) for m in (letter, (kind & _LOWER) != 0, digit))
        tail = (kind[start + size - 1] & _TAIL) != 0
        repeated = _same_as_next(codes, start, size)
        repeated[:-1] &= text[:-1] == text[1:]
        found = {"plain_word_share": (letters == size) | (tail & (size > 1) & (letters == size - 1)), "short_word_share": size <= 2,
                 "long_word_share": size >= 16, "repeated_word_share": repeated,
                 "capital_word_share": ((kind[start] & _UPPER) != 0) & (lowers == size - 1), "bare_number_share": digits == size}
    else:
        found = {k: np.zeros(0, bool) for k in ("plain_word_share", "short_word_share", "long_word_share", "repeated_word_share",
                                                "capital_word_share", "bare_number_share")}
    return out | {"words": words} | {k: of_words(m) for k, m in found.items()}


def shares(texts: list[str]) -> dict[str, np.ndarray]:
    """STATISTICS of every text, as doubles; those of an empty text are 0."""
    if not texts:
        return {k: np.zeros(0) for k in STATISTICS}
    c = counts(texts)
    per = {"chars": np.maximum(c["chars"], 1.0), "words": np.maximum(c["words"], 1.0), "letters": np.maximum(c["letter_share"], 1.0)}
    return {"log_chars": np.log2(c["chars"] + 1.0), "word_chars": c["chars"] / per["words"],
            **{k: c[k] / per[of] for k, (_, of) in (CLASSES | MATCHES).items()}}


def with_statistics(rows: DataFrame, text: str = "text", into: str = "s") -> DataFrame:
    """``rows`` with a struct of STATISTICS in place of the column ``text``, without a shuffle.

    Whole texts are read, in blocks of about BLOCK_CHARS; a longer text is a block by itself and takes some 20 bytes a character. A null or empty text has
    zeros; bytes that are not UTF-8 count as replacement characters; rows may repeat; an empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in (text, into)]
    kind = pa.struct([(k, pa.float64()) for k in STATISTICS])

    def go(batches):
        for batch in batches:
            texts = ["" if b is None else str(b, "utf-8", "replace") for b in batch[text].cast(pa.binary()).to_pylist()]
            for a, b in balanced([len(t) for t in texts], BLOCK_CHARS):
                found = shares(texts[a:b])
                s = pa.StructArray.from_arrays([pa.array(found[k]) for k in STATISTICS], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(a, b - a) for c in kept], s], [*kept, into])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]
    inner = ",".join(f"{k}:double" for k in STATISTICS)
    return rows.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(go, ", ".join([*fields, f"`{into}` struct<{inner}>"]))

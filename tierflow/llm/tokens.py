"""Token ids by public tokenizer files, chunk by chunk.

A text is cut where a token can't cross: between an ASCII letter and a full stop, comma or the like, and before ASCII
white space that follows a character which is neither white space nor anything a tokenizer's pattern might take for
it. The library encodes every distinct chunk it has not met yet, many in one call with a special token between them;
the ids of a text are those of its chunks in a row. Special strings hold no white space, so they
stay whole and are treated as the library does by default.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from tierflow.llm.common import held

MEMO = 1_000_000  # chunks a worker remembers; beyond that it starts anew
#: White space or control characters beyond ASCII's six; a cut never follows one.
_ODD = "\x00-\x08\x0e-\x1f\x7f-\xa0̀-ͯ ᠎ -‏ -  -⁤　﻿"
_CHUNK = re.compile(rf"[ \t-\r]*[A-Za-z]+(?=[ \t-\r.,;:!?])|[ \t-\r]*[^ \t-\r]*(?:(?<=[{_ODD}])[ \t-\r]+[^ \t-\r]*)*")


def chunks(text: str) -> list[str]:
    out = _CHUNK.findall(text)
    out.pop()  # the pattern matches the end of the text once more
    return out


class _Numbers(dict):
    """Numbers strings in the order in which they are asked for, and lists the new ones."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids or lengths of texts for one tokenizer file (.json: tokenizers, .model: sentencepiece without cuts)."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            special = [t for t in json.loads(library.to_str())["added_tokens"] if t["special"]]
            self._call = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            self._mark = (special[0]["content"], special[0]["id"]) if special else None
            self._cut = chunks
        elif path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._call, self._mark = lambda texts: model.encode(texts, num_threads=1), None
            self._cut = lambda text: [text]
        else:
            raise ValueError(f"no library for {path}")
        self._forget()

    def _forget(self):
        self._at = _Numbers()
        self._size = np.zeros(1 << 12, np.int64)  # ids of each remembered chunk
        self._flat, self._used = np.zeros(1 << 14, np.uint32), 0  # all their ids, in the same order
        self._begin = np.zeros(1 << 12, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        text, number = self._mark or ("", -1)
        joined = text.join(words)
        if not text or joined.count("<") != text.count("<") * (len(words) - 1):  # a special string may be near
            found = self._call(words)
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64)
        ids = np.array(self._call([joined])[0], np.uint32)
        at = np.flatnonzero(ids == number)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _learn(self, words: list[str]) -> None:
        """Adds what the library says of new words, which have the last numbers."""
        n = len(self._at) - len(words)
        for a in range(0, len(words), 4096):
            ids, size = self._encode(words[a:a + 4096])
            end = self._used + np.cumsum(size)
            m = n + a + len(size)
            self._size, self._begin = _room(self._size, m), _room(self._begin, m)
            self._flat = _room(self._flat, int(end[-1]))
            self._size[n + a:m], self._begin[n + a:m] = size, end - size
            self._flat[self._used:end[-1]] = ids
            self._used = int(end[-1])

    def _cut_and_find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each chunk of the texts in a row, and where each text's chunks end."""
        cut = [self._cut(t) for t in texts]
        if len(self._at) > MEMO:
            self._forget()
        stop = np.cumsum([0, *map(len, cut)], dtype=np.int64)
        self._at.new = []
        at = np.fromiter(map(self._at.__getitem__, chain.from_iterable(cut)), np.int64, int(stop[-1]))
        self._learn(self._at.new)
        return at, stop

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        at, stop = self._cut_and_find(texts)
        count = self._size[at]
        end = np.concatenate([[0], np.cumsum(count)])
        ids = self._flat[np.repeat(self._begin[at] - end[:-1], count) + np.arange(end[-1])]
        return np.split(ids, end[stop[1:-1]]) if texts else []

    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        at, stop = self._cut_and_find(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self._size[at])])[stop]).tolist()


def _room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros((max(n, 2 * len(array)) - len(array), *array.shape[1:]), array.dtype)])


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return held(path, lambda: Encoder(path))


PIECE_CHARS = 1 << 20


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cuts a long text into pieces of about ``size`` characters whose tokens are those of the whole text.

    A cut comes before a single space between two ASCII letters; a text without one stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


_SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def balanced(sizes, limit: int):
    """Ranges [a, b) of consecutive texts of about ``limit`` bytes together."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)

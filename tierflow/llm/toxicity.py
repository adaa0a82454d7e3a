"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes the document's score.

Only documents have labels. A document is clean if every sentence is: 1 - score is the product over its sentences of
1 - p, with p a logistic function of the sentence's words and their stems. The weights are fitted to the documents' labels, so the
sentences that make a document toxic come out by themselves.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tierflow.llm.common import doc_rows, held
from tierflow.llm.tokens import _Numbers, _room, balanced

SAMPLE = 10_000  # labelled documents that a fit reads, about
SLOTS = 1 << 18
STEMS = (4, 5)  # first letters that count as a feature of their own, for inflected words
STEPS = 120
DECAY = 3e-5  # pull of the weights towards 0
RARE = 10  # a word in fewer training documents gets no weight
FOLDS = 5
MEMO = 1_000_000
BATCH_BYTES = 1 << 20
_PART = re.compile(r"[^\W_]+|[.!?\n]")


def _slots(word: str) -> list[int]:
    """A slot for the word and one for each stem it is longer than; -1 where there is none."""
    if word in ".!?\n":
        return [-1] * (1 + len(STEMS))
    low = word.lower()
    return [zlib.crc32(low.encode()) % SLOTS, *(zlib.crc32(f"{low[:n]}-".encode()) % SLOTS if len(low) > n else -1 for n in STEMS)]


class _Reader:
    """Texts as words' slots and sentence numbers; words are looked up."""

    def __init__(self):
        self.at, self.slot = _Numbers(), np.full((1024, 1 + len(STEMS)), -1, np.int32)

    def read(self, texts: list[str], useful: np.ndarray | None = None):
        """Slot and sentence of the distinct (useful) words of every sentence, and the first sentence of each text."""
        if len(self.at) > MEMO:
            self.__init__()
        cut = [_PART.findall(t) for t in texts]
        size = np.array([len(c) for c in cut], np.int64)
        self.at.new = []
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        if new := self.at.new:
            n = len(self.at)
            self.slot = _room(self.slot, n)
            self.slot[n - len(new):n] = [_slots(w) for w in new]
        slot = self.slot[at]
        # a text begins a sentence, and so does what follows a sign
        sign = slot[:, 0] < 0
        sentence = np.cumsum(sign)
        text = np.repeat(np.arange(len(texts)), size)
        sentence = sentence + text
        first = np.concatenate([[0], np.cumsum(np.bincount(text, sign, len(texts)) + 1)]).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        word, column = np.nonzero((slot >= 0) if useful is None else (slot >= 0) & useful[slot])
        pair = np.unique(sentence[word] * SLOTS + slot[word, column])  # a word counts once in a sentence
        return pair % SLOTS, pair // SLOTS, first


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences, numbered as _Reader does."""
    ends = [m.start() for m in re.finditer(r"[.!?\n]", text)]
    return list(zip([0, *(e + 1 for e in ends)], [*(e + 1 for e in ends), len(text)]))


def fit(docs: list[str], labels: np.ndarray, steps: int = STEPS, rare: int = RARE,
        decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the documents' log loss under noisy-or."""
    w, bias = np.zeros(SLOTS), -5.0
    if not docs or not labels.any():
        return w, -30.0
    reader, parts, first = _Reader(), [], np.zeros(1, np.int64)
    held = np.zeros(SLOTS, np.int64)  # documents that hold a slot
    for a, b in balanced([len(t) for t in docs], BATCH_BYTES):
        s, n, f = reader.read(docs[a:b])
        doc = np.searchsorted(f, n, "right") - 1
        held += np.bincount(np.unique(doc * SLOTS + s) % SLOTS, minlength=SLOTS)
        parts.append((s.astype(np.int32), (n + first[-1]).astype(np.int32)))
        first = np.concatenate([first, f[1:] + first[-1]])
    del reader
    common = held >= rare
    names, number = np.flatnonzero(common), (np.cumsum(common) - 1).astype(np.int32)
    slot = np.concatenate([number[s[common[s]]] for s, _ in parts])
    sentence = np.concatenate([n[common[s]] for s, n in parts])
    del parts
    doc_of = np.repeat(np.arange(len(docs)), np.diff(first))
    total, y = int(first[-1]), labels.astype(float)
    v = np.zeros(len(names) + 1)
    v[-1] = bias
    m, q = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, v[slot], total) + v[-1]
        soft = np.logaddexp(0, z)
        miss = np.bincount(doc_of, soft, len(docs))  # -log of 1 - score
        hit = np.maximum(-np.expm1(-miss), 1e-12)
        pull = (1 - y) - y * np.exp(-miss) / hit
        g = pull[doc_of] * np.exp(z - soft)
        grad = np.append(np.bincount(slot, g[sentence], len(names)), g.sum()) / len(docs)
        grad[:-1] += decay * v[:-1]
        m, q = .9 * m + .1 * grad, .99 * q + .01 * grad * grad
        v -= .15 * (m / (1 - .9 ** t)) / (np.sqrt(q / (1 - .99 ** t)) + 1e-7)
    w[names] = v[:-1]
    return w, float(v[-1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on about ``sample`` labelled documents outside the held-out fold, picked by a hash of doc_id, in one task."""
    own = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = own.count()
    share = min(1.0, sample / max(1, n))
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the ids picked are about ``sample`` in number, whatever the size of the tables
    rows = doc_rows(docs).join(F.broadcast(picked), "doc_id")

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        w, bias = fit(table["text"].to_pylist(), table["toxic"].to_numpy())
        return pa.table([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    got = rows.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(go, "w binary, bias double").collect()
    return (np.frombuffer(got[0]["w"], "<f4").astype(float), got[0]["bias"]) if got else (np.zeros(SLOTS), -30.0)


def _judge(texts: list[str], w: np.ndarray, bias: float):
    """Score of each text, its sentences' probabilities, and where they begin."""
    slot, sentence, first = held("toxicity", _Reader).read(texts, w != 0)
    z = np.bincount(sentence, w[slot], int(first[-1])) + bias
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    soft = np.logaddexp(0, z)
    return -np.expm1(-np.bincount(doc, soft, len(texts))), -np.expm1(-soft), first


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences (start, end, score of those that are toxic by themselves), one row per row of ``docs``.

    Every whole text is scored; labels are learnt from documents whose crc32(doc_id) mod 5 is not 0. A null or empty
    text has one empty sentence and gets the bias alone; a null doc_id is not held out; repeated rows are scored each; labels that are null,
    repeated or not 0/1 are skipped, or the larger taken; without any label 1 all scores are near 0; an empty table gives no rows;
    other columns are ignored.
    """
    w, bias = train(docs, labels, sample)
    weights = w.astype("<f4")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def go(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in balanced([len(t) for t in texts], BATCH_BYTES):
                total, each, first = _judge(texts[a:b], weights, bias)
                found = []
                for k, t in enumerate(texts[a:b]):
                    bad = np.flatnonzero(each[first[k]:first[k + 1]] >= .5).tolist()
                    spans = sentence_spans(t) if bad else []
                    found.append([{"start": spans[j][0], "end": spans[j][1], "score": float(each[first[k] + j])} for j in bad])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(total, pa.float64()), pa.array(found, kind)],
                                                 ["doc_id", "score", "sentences"])

    out = doc_rows(docs).mapInArrow(go, "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= .5).cast("int").alias("predicted"), "sentences")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below one half."""
    w, bias = train(docs, labels, sample)
    weights = w.astype("<f4")

    def go(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].to_pylist()]
            for a, b in balanced([len(t) for t in texts], BATCH_BYTES):
                yield batch.slice(a, b - a).filter(pa.array(_judge(texts[a:b], weights, bias)[0] < .5))

    return docs.mapInArrow(go, docs.schema)

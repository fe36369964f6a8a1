"""Toxicity by class-conditional Kneser-Ney models over byte runs.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of its own counts of long runs; short runs back off
to continuation counts shared by both classes, so that a rare expression is judged by what it is made of instead of by
which class happened to hold it. The evidence is the difference of the two length-normalised log-likelihoods, for the
whole text and for its words, whose largest differences tell a few toxic words in a long text. A logistic curve turns the
evidence into a probability; it is fitted on labelled documents that the counts have not seen, a fold at a time, weighted
so that both classes have their shares of all labelled documents, however many of either the model is fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm._grams import BLOCK, Tables, grams, suffix_index, within
from siltbed.llm.common import free_name, sliced

#: Labelled documents that a model is fitted on at most: of each class, those with the least hashes of their ids, in that
#: order, without those that would take the class beyond so many bytes.
TOXIC_DOCS, ORDINARY_DOCS, CLASS_BYTES = 3000, 6000, 48 << 20
#: Parts of the labelled documents: each is held against counts of the others.
FOLDS = 3
SIZE, ORDER, SHARED_BELOW, DISCOUNT = 32, 4, 2, 0.75


def symbol_table() -> np.ndarray:
    """Letters a-z (A-Z folded), space, digit, punctuation, and three kinds of non-ASCII byte."""
    t = np.full(256, 28, np.uint8)
    t[0xC0:], t[0x80:0xA0], t[0xA0:0xC0] = 29, 30, 31
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i + 1
    t[ord("0") : ord("9") + 1] = 27
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


class KneserNey:
    """Log-likelihood ratios ln P(symbol | context, toxic) - ln P(symbol | context, ordinary)."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]):
        symbols = symbol_table()
        counts = [grams(texts, symbols, SIZE, ORDER) for texts in (ordinary, toxic)]
        contexts = [np.zeros(1, np.int64)]
        for k in range(1, ORDER + 1):
            contexts.append(np.union1d(counts[0][k][0] // SIZE, counts[1][k][0] // SIZE))
        index, starts = suffix_index(contexts, SIZE, ORDER)
        ratio = np.zeros((starts[-1] + len(contexts[-1]), SIZE), np.float32)
        lower = [np.full((1, SIZE), 1 / SIZE)] * 2
        for k in range(ORDER + 1):
            tables = [self._counts(counts, [c], k, contexts[k]) for c in (0, 1)] if k >= SHARED_BELOW else [self._counts(counts, [0, 1], k, contexts[k])] * 2
            suffix = np.searchsorted(contexts[k - 1], contexts[k] % SIZE ** (k - 1)) if k else np.zeros(1, int)
            now = []
            for n, below in zip(tables, lower, strict=True):
                total = n.sum(1, keepdims=True)
                back = np.where(total > 0, DISCOUNT * (n > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1)
                now.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1) + back * below[suffix])
            ratio[starts[k] : starts[k] + len(contexts[k])] = np.log(now[1]) - np.log(now[0])
            lower = now
        self.tables = Tables(symbols, SIZE, ORDER, index, ratio.reshape(-1, 1))

    @staticmethod
    def _counts(counts: list, classes: list[int], k: int, contexts: np.ndarray) -> np.ndarray:
        """Counts of the longest runs; for shorter ones the number of distinct symbols that go before them."""
        out = np.zeros((len(contexts), SIZE))
        if k == ORDER:
            pairs = [counts[c][k] for c in classes]
        else:
            longer = [counts[c][k + 1][0] for c in classes]
            keys = np.unique(np.concatenate(longer)) % SIZE ** (k + 1)
            pairs = [np.unique(keys, return_counts=True)]
        for keys, n in pairs:
            np.add.at(out, (np.searchsorted(contexts, keys // SIZE), keys % SIZE), n)
        return out

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Six numbers a text: mean ratio of its bytes; sum over the words that lean clearly to toxic, by the root of the
        length; logarithms of that sum, of the length, of the ratio of the word that leans most, and of the mean ratio of
        the three that do. An empty text has one byte without a ratio."""
        out = np.zeros((len(texts), 6))
        for i, text in enumerate(texts):
            total = top = 0.0
            most = np.zeros(3)
            for at in range(0, len(text), BLOCK):
                raw = text[at : at + BLOCK]
                r = self.tables._gather((b" " * ORDER + text[max(0, at - ORDER) : at])[-ORDER:] + raw)[:, 0].astype(np.float64)
                total += r.sum()
                blank = self.tables.symbols[np.frombuffer(raw, np.uint8)] == 0
                words = np.add.reduceat(r, np.flatnonzero(np.r_[True, blank[:-1]]))
                top += words[words > WORD_LEAN].sum()
                most = np.sort(np.r_[most, words[words > most[0]]])[-3:]
            n = max(1, len(text))
            out[i] = total / n, top / n**0.5, np.log1p(top), np.log(n + 200), np.log1p(most[-1]), np.log1p(most.mean())
        return out


#: A word counts as leaning to toxic beyond this log-likelihood ratio.
WORD_LEAN = 4.0


class Model:
    def __init__(self, ordinary: list[bytes], toxic: list[bytes], labelled: tuple[int, int] | None = None):
        """Counts of all texts; the logistic curve comes from each fold's evidence under counts of the other folds. A fold
        is chosen by the text's checksum, so that equal texts share it. Either class may be empty.

        labelled: how many labelled documents, ordinary and toxic, the texts stand for (else the texts are all). The
        curve is fitted with the odds of these, not with those of the texts."""
        labelled = np.array(labelled or (len(ordinary), len(toxic)), float)
        self.prior = (labelled[1] + 0.5) / (labelled.sum() + 1)
        self.trained = bool(ordinary and toxic)
        if not self.trained:
            return
        fold = lambda texts, f, own: [t for t in texts if (zlib.crc32(t) % FOLDS == f) == own]
        x, y = [], []
        for f in range(FOLDS):
            known, held = [fold(t, f, False) for t in (ordinary, toxic)], [fold(t, f, True) for t in (ordinary, toxic)]
            if all(known) and any(held):
                kn = KneserNey(*known)
                x += [kn.evidence(h) for h in held]
                y += [np.full(len(h), float(c)) for c, h in enumerate(held)]
        self.kn = KneserNey(ordinary, toxic)
        x, y = (np.concatenate(x), np.concatenate(y)) if x else (np.zeros((0, 6)), np.zeros(0))
        if y.min(initial=1) == y.max(initial=0):  # too few texts for folds that have both classes
            x = np.concatenate([self.kn.evidence(t) for t in (ordinary, toxic)])
            y = np.r_[np.zeros(len(ordinary)), np.ones(len(toxic))]
        weight = (labelled / labelled.sum() / (np.bincount(y.astype(int), minlength=2) / len(y)))[y.astype(int)]
        self.mean, self.sd = x.mean(0), np.maximum(x.std(0), 1e-9)
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.sd]
        self.w = np.zeros(x.shape[1])
        ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
        for _ in range(30):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ self.w)
            self.w += np.clip(step, -5, 5)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), min(self.prior, 0.499))
        x = np.c_[np.ones(len(texts)), (self.kn.evidence(texts) - self.mean) / self.sd]
        return 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Fit on at most TOXIC_DOCS + ORDINARY_DOCS labelled documents, of at most CLASS_BYTES a class. Null labels, keys and
    texts do not take part; a document with labels of both kinds counts as toxic. The chosen texts reach the driver in
    order, one partition at a time. The labelled documents of either class are counted without any bound."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    least = lambda y, n: marked.where(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(n)
    chosen = least(0, ORDINARY_DOCS).union(least(1, TOXIC_DOCS))
    told = docs.where("text is not null").select(key, "text")
    labelled = {r["toxic"]: r["count"] for r in marked.join(told.select(key), key, "left_semi").groupBy("toxic").count().collect()}
    found = told.join(F.broadcast(chosen), key)
    rows = found.groupBy(key, "toxic").agg(F.min("text").alias("text"))  # a repeated key counts once
    rows = rows.orderBy(F.xxhash64(key), key).select("toxic", "text").toLocalIterator()
    texts = within(((y, text.encode("utf-8", "replace")) for y, text in rows), CLASS_BYTES)
    return Model(texts.get(0, []), texts.get(1, []), (labelled.get(0, 0), labelled.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (double, 0 to 1) and `predicted` (int, 1 from 0.5 on).

    One narrow pass over whole texts, no shuffle. Null texts count as empty, and an empty text gets the score of no
    evidence. All other columns, nulls and repeated rows pass through; on a clash the new names get underscores in
    front. Without training documents of both classes every score is the prior, below 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name, pred = free_name(docs, "score"), free_name(docs, "predicted")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s = shared.value.score([(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, name, pred])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name), F.lit(0).alias(pred)).schema)

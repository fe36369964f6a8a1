"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree, held as counts of byte runs. The probability of a byte in a
context is its count over the context's total plus its number of distinct successors (escape method C); the escape
mass goes to the next shorter context, over the bytes not yet offered (full exclusion), down to a uniform order -1.
Statistics are frozen after training, so every code length is a table entry, and the code length of a text is a sum.
The text belongs to the language whose tree codes it in the fewest bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm._grams import Tables, grams, suffix_index, within
from siltbed.llm.common import free_name, sliced

UNDETERMINED = "und"
#: Documents per language that a model is fitted on at most: SALTS x PER_SALT, those with the least hashes.
SALTS, PER_SALT = 64, 6
#: Bytes per language at most: texts that would go beyond are left out of the fit.
LANGUAGE_BYTES = 32 << 20
#: Bytes of the tables at most, whatever the number of languages: rare contexts are left out until they fit.
TABLE_BYTES = 256 << 20
LETTER = re.compile(r"[^\W\d_]")


def training_sample(docs: DataFrame, key: str = "doc_id", per_salt: int = PER_SALT) -> DataFrame:
    """(lang, text) of at most SALTS * per_salt documents of each language.

    Rows with null lang or null text do not take part. The rank window is over (lang, salt), so that no task gets all
    rows of a frequent language, and only keys pass through it; texts are fetched for the few chosen keys.
    """
    h = F.xxhash64(F.col(key))
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "lang", h.alias("_h"))
    w = Window.partitionBy("lang", F.pmod("_h", F.lit(SALTS))).orderBy("_h", key)
    chosen = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_salt).select(key).distinct()
    found = docs.where("lang is not null and text is not null").join(F.broadcast(chosen), key)
    return found.groupBy(key, "lang").agg(F.min("text").alias("text")).select("lang", "text")  # a repeated key counts once


class PPM:
    """Frozen statistics of all languages: bits[context number * size + symbol, language]."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3, min_count: int = 2):
        """Contexts seen fewer than min_count times over all languages are not stored; min_count doubles until the tables
        have TABLE_BYTES at most."""
        self.languages = sorted(samples)
        if not samples:
            return
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        seen[32] = True
        # bytes that no language has seen share symbol 0 and its order -1 probability
        symbols = np.zeros(256, np.uint8)
        symbols[seen] = np.arange(1, seen.sum() + 1)
        size = int(seen.sum()) + 1
        base = np.full(size, 1 / 256)
        base[0] = max(1, 256 - size + 1) / 256
        counts = [grams(samples[lang], symbols, size, order) for lang in self.languages]
        contexts = self._stored(counts, size, order, min_count)
        while len(contexts) > 1 and sum(map(len, contexts)) * size * len(counts) * 4 > TABLE_BYTES and any(map(len, contexts[1:])):
            min_count *= 2
            contexts = self._stored(counts, size, order, min_count)
        index, starts = suffix_index(contexts, size, order)
        bits = np.zeros((starts[-1] + len(contexts[-1]), size, len(self.languages)), np.float32)
        for j, g in enumerate(counts):
            lower = None
            for k in range(order + 1):
                if not len(contexts[k]):
                    break  # nor are there longer ones
                seen_here = np.zeros((len(contexts[k]), size))
                keys, c = g[k]
                at = np.searchsorted(contexts[k], keys // size)
                at[at == len(contexts[k])] = 0
                ok = contexts[k][at] == keys // size
                seen_here[at[ok], keys[ok] % size] = c[ok]
                total, distinct = seen_here.sum(1, keepdims=True), (seen_here > 0).sum(1, keepdims=True)
                suffix = base[None] if k == 0 else lower[np.searchsorted(contexts[k - 1], contexts[k] % size ** (k - 1))]
                rest = np.where(seen_here > 0, 0, suffix)
                left = rest.sum(1, keepdims=True)
                # with every symbol offered there is nothing to escape to; an unseen context is all escape
                escape = np.where(left > 0, distinct / np.maximum(total + distinct, 1), 0)
                escape[total == 0] = 1
                p = (1 - escape) * seen_here / np.maximum(total, 1) + escape * rest / np.where(left > 0, left, 1)
                bits[starts[k] : starts[k] + len(p), :, j] = -np.log2(np.maximum(p, 1e-12))
                lower = p
        self.tables = Tables(symbols, size, order, index, bits.reshape(-1, len(self.languages)))

    @staticmethod
    def _stored(counts: list, size: int, order: int, min_count: int) -> list[np.ndarray]:
        """The contexts of each length that are seen often enough, and whose suffix is."""
        contexts = [np.zeros(1, np.int64)]
        for k in range(1, order + 1):
            keys, c = np.unique(np.concatenate([g[k - 1][0] for g in counts]), return_inverse=True)
            total = np.bincount(c, weights=np.concatenate([g[k - 1][1] for g in counts]))
            keys = keys[total >= min_count]
            contexts.append(keys[np.isin(keys % size ** (k - 1), contexts[k - 1])] if k > 1 else keys)
        return contexts

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        return self.tables.score(texts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths([(t or "").encode("utf-8", "replace") for t in texts])
        best = bits.argmin(1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        lettered = [t is not None and LETTER.search(t) is not None for t in texts]
        return (
            [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)],
            [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)],
        )


def fit(sample: DataFrame, order: int = 3) -> PPM:
    """Fit on a bounded sample (see `training_sample`), of at most LANGUAGE_BYTES a language; rows with null lang or text
    are left out. Texts reach the driver in the order of their hashes, one partition at a time."""
    rows = sample.where("lang is not null and text is not null").orderBy(F.xxhash64("text"), "text").toLocalIterator()
    return PPM(within(((lang, text.encode("utf-8", "replace")) for lang, text in rows), LANGUAGE_BYTES), order)


def identify(docs: DataFrame, model: PPM, text: str = "text") -> DataFrame:
    """docs with `lang_pred` (string) and `score` (double, posterior of that language under equal priors).

    One narrow pass, no shuffle. Null texts and texts without a letter get `und` and score 0. Every other column,
    nulls and repeated rows pass through; if docs has columns of these two names, the new ones get underscores in front.
    With no training data every text is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in sliced(batches):
            langs, scores = ppm.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, pred, score])

    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, schema)

"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits; one binary classifier per bit,
linear in hashed character n-grams (1 to 3 letters, blanks at word edges),
predicts it.  Decoding is loss-weighted: a language's loss is the weighted sum
over bits of log(1 + exp(-bit * margin)), the weights being the bits' accuracies
above chance on every fifth training text, which a first fit leaves out; the
least loss wins, and the prediction is flagged ambiguous when the runner-up's
probability is too close.

Texts are scored in pieces of about ``CELLS`` / bits characters, a long one in
several of its own whose sums add up, so that a worker's memory depends neither
on a text's length nor on the number of languages.

Learning takes at most about ``PER_LANGUAGE`` texts of each language, chosen
by a hash of the id, so that the driver's memory is bounded; everything else
covers whole texts of all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and flagged ambiguous; with no training language at all everything is ``und``;
with a single one everything that has letters is that one with score 1;
repeated rows are predicted one by one; other columns are only carried if
named; an empty table gives an empty result.  Ties go to the language that
comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LONGEST_TRAINED, code_points, sample_by_class, segment_sums, slices, tidy

PER_LANGUAGE = 500
BUCKETS = 1 << 15
AMBIGUOUS = 0.10
#: Margins are averages over n-grams; this many n-grams' worth of evidence is believed at most.
EVIDENCE = 60.0

#: Positions times bits that are held at once.
CELLS = 1 << 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter's code, or 0 for anything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(len(table)):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +1/-1.  Up to 7 languages: all 2**(n-1) - 1 splits; beyond, rows of a
    Hadamard matrix without the constant column, whose pairwise distances are equal."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        rest = ((bits[None, :] >> np.arange(n - 1)[:, None]) & 1).astype(np.int8)
        return np.vstack([np.zeros((1, len(bits)), dtype=np.int8), rest]) * 2 - 1
    h = np.ones((1, 1), dtype=np.int8)
    while len(h) < n + 1:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:].astype(np.int8)


def ngram_ids(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed 1-, 2- and 3-gram ids per position, whether the position's n-grams count).

    Positions are those of the letters; a gram ends at its position and its
    last character is a letter, or a blank after one.
    """
    c = _letters()[points]
    p1 = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    p2 = np.concatenate([[0], p1[:-1]]).astype(np.uint32)
    one = (c * np.uint32(2654435761)) >> np.uint32(17)
    two = ((c * np.uint32(2246822519)) ^ (p1 * np.uint32(3266489917))) * np.uint32(668265263) >> np.uint32(17)
    three = (((c * np.uint32(374761393)) ^ (p1 * np.uint32(2246822519)) ^ (p2 * np.uint32(3266489917))) * np.uint32(2654435761)) >> np.uint32(17)
    return np.stack([one, two, three]), (c > 0) | (p1 > 0)


def _pieces(texts: list[str], most: int) -> Iterator[tuple[list[int], int, list[str]]]:
    """(texts' numbers, characters of context before each piece, pieces) of at most about ``most`` characters."""
    run: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if run and size + len(t) > most:
            yield run, 0, [texts[j] for j in run]
            run, size = [], 0
        if len(t) > most:
            for a in range(0, len(t), most):
                yield [i], min(a, 2), [t[max(0, a - 2) : a + most]]
        else:
            run.append(i)
            size += len(t) + 2
    if run:
        yield run, 0, [texts[j] for j in run]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    bit_weights: np.ndarray
    #: (3, BUCKETS, bits): per n-gram length
    table: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: believed evidence per bit, and whether it has a letter."""
        total = np.zeros((len(texts), self.codes.shape[1]))
        n, letters = np.zeros(len(texts)), np.zeros(len(texts))
        for who, context, pieces in _pieces(texts, max(1 << 10, CELLS // self.codes.shape[1])):
            size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            points = code_points("  ".join(pieces))  # two blanks: no gram reaches into the text before
            ends = np.cumsum(size + 2) - 2
            starts = ends - size + context
            grams, counts = ngram_ids(points)
            value = self.table[0][grams[0]]
            value += self.table[1][grams[1]]
            value += self.table[2][grams[2]]
            value *= counts[:, None]
            total[who] += segment_sums(value, starts, ends)
            n[who] += segment_sums(counts, starts, ends)
            letters[who] += segment_sums(_letters()[points] > 0, starts, ends)
        return total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None], letters > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, probability, ambiguous) of each text."""
        margin, lettered = self.margins(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None, :, :]) @ self.bit_weights
        # the distance of two codewords is half the bits: scale to one log-odds
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ranked = np.sort(p, axis=1)
        gap = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
        told = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
        return told, np.where(lettered, ranked[:, -1], 0.0), ~lettered | (gap < AMBIGUOUS)


def _tables(texts: list[str], langs: list[str], languages: list[str], codes: np.ndarray, smooth: float) -> np.ndarray:
    """Log odds of each n-gram for each bit; every language weighs the same in its side of a split."""
    counts = np.zeros((len(languages), 3, BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    for t, name in zip(texts, langs):
        grams, on = ngram_ids(code_points(t + " "))
        for k in range(3):
            counts[place[name], k] += np.bincount(grams[k][on], minlength=BUCKETS)
    share = counts + smooth
    share /= np.maximum(share.sum(2, keepdims=True), 1)
    table = np.zeros((3, BUCKETS, codes.shape[1]), dtype=np.float32)
    for b in range(codes.shape[1]):
        up, down = codes[:, b] > 0, codes[:, b] < 0
        if up.any() and down.any():
            table[:, :, b] = np.log(share[up].mean(0)) - np.log(share[down].mean(0))
    return table


def fit(texts: list[str], langs: list[str], smooth: float = 0.5) -> Model:
    """Binary naive-Bayes classifiers of the bits, weighed by how often they are right on texts that were left out."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    model = Model(languages, codes.astype(np.float64), np.ones(codes.shape[1]) / codes.shape[1], np.zeros((3, BUCKETS, codes.shape[1]), dtype=np.float32))
    if len(languages) < 2:
        return model
    apart = [i for i in range(len(texts)) if i % 5 == 4]
    rest = [i for i in range(len(texts)) if i % 5 != 4]
    if apart:
        model.table = _tables([texts[i] for i in rest], [langs[i] for i in rest], languages, codes, smooth)
        margin, lettered = model.margins([texts[i] for i in apart])
        truth = codes[[languages.index(langs[i]) for i in apart]]
        right = ((np.sign(margin) == truth) & lettered[:, None]).sum(0)
        # two pseudo-texts at chance keep a few texts from deciding
        weight = np.maximum(2 * (right + 1) / (lettered.sum() + 2) - 1, 0.05)
        model.bit_weights = weight / weight.sum()
    model.table = _tables(texts, langs, languages, codes, smooth)
    return model


def train_model(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on a bounded sample of rows where ``use`` holds and lang isn't null; by default crc32(key) mod 3 is not 1."""
    use = F.crc32(F.col(key).cast("string")) % 3 != 1 if use is None else use
    rows = train.where(use & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.coalesce(F.length(text), F.lit(0)) <= LONGEST_TRAINED))
    chosen = sample_by_class(rows.select(key, text, lang), lang, key, per_language).select(text, lang)
    found = sorted((r[1], r[0] or "") for r in chosen.collect())
    return fit([t for _, t in found], [name for name, _ in found])


def predict_language(docs: DataFrame, train: DataFrame | None = None, model: Model | None = None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, ambiguous[, carried]) of every row; the model is fitted on ``train`` unless given.

    Prediction is map only.  Of a row only the text is used.
    """
    model = model or train_model(docs if train is None else train, key, text)
    others = tuple(c for c in carry if c != key)
    rows = docs.select(F.col(text).alias("__text"), key, *others)
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *others)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(0).to_pylist(), 1 << 19):
                told, score, unsure = m.predict(texts)
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_pydict({name: own.column(1 + i) for i, name in enumerate((key, *others))} | {"lang_pred": told, "score": score, "ambiguous": unsure})

    return rows.mapInArrow(tidy(run), ", ".join([*types, "lang_pred string, score double, ambiguous boolean"]))

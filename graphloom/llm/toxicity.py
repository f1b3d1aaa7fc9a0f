"""Toxicity of text restored by a noisy-channel decoder.

1. Suspicious stretches are found by linear scans: words that hold leetspeak
   characters, letters repeated three times or more, letters spelled out with
   blanks, dots or dashes between them.
2. Each is a lattice: every character may stand for itself, for the letters it
   imitates, for nothing (separators, decoration) or repeat the letter before
   it, at a channel cost.  Viterbi decoding under a character trigram model
   finds the most likely restored words.
3. The restored text is scored: lexicon entries (words, and stems that words
   begin with), by how often they occur, add up to a logistic score.

The lexicon is chosen greedily by how many toxic training documents an entry
explains that no chosen entry does yet, among those that are much rarer in the
others, at most ``MOST_ENTRIES`` of them.  It and its weights are learnt from at
most about ``PER_CLASS`` labelled documents of each class, so that the driver's
memory is bounded: first from their texts as they are, which makes a channel
model good enough to restore them, then from the restored texts, so that
disguised words are learnt as what they stand for.  The
character model counts the letters of the whole texts of all documents, with or
without a label; only its table of distinct trigrams, which the languages'
alphabets bound, is gathered.  Scoring covers whole texts of all rows, map only.

Defined results: a null text counts as empty; an empty one has no lexicon word
and gets the score of such texts; without labels of both classes every score is
the prior (0 without any label); repeated rows are scored one by one; columns
other than key and text are not read; an empty table gives an empty result.
Ties between readings go to the one with the smaller text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import code_points, labelled_texts, slices, tidy

PER_CLASS = 1200
WORD = re.compile(r"[^\W\d_]+")
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
PUNCTUATION = "!|+($"
SEPARATORS = " .-_*~'"
SWAP, DROP, REPEAT, SPLIT_COST, DECORATION = 0.5, 0.3, 0.05, 1.0, 9.0
SIGN = re.compile(r"[0-9@$!|+€¡£*]")
THRICE = re.compile(r"([^\W\d_])\1(?:\1|([^\W\d_])\2([^\W\d_])\3)")
#: Two characters parted by a sign, at least one of them by itself, as spelled-out words have within a token.
INNER = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])[.\-_*~](?:[^\W_]|[@$!|+])|(?:[^\W_]|[@$!|+])[.\-_*~](?:[^\W_]|[@$!|+])(?![^\W_])")
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~][^\W_@$!|+]){3,}(?![^\W_])|(?<![^\W_])[^\W_](?:[ .\-_*~][^\W_]|[ .\-_*~][@$!|+]){3,}(?![^\W_])")
GAP = re.compile(r"\s")
EDGE = ".,;:?\"'()[]{}<>#%&*=~`^/\\"
#: Entries of the lexicon at most.
MOST_ENTRIES = 300
#: Readings, and tokens, of at most ``SHORT`` characters that are kept while a task runs; beyond it the table starts anew.
CACHED, SHORT = 100_000, 48
STEMS = (3, 4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)


@dataclass
class Model:
    prior: float
    lexicon: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    grams: dict[str, float] = field(default_factory=dict)
    names: frozenset[str] = frozenset()
    known: dict[str, str] = field(default_factory=dict, compare=False)
    seen: set[str] = field(default_factory=set, compare=False)
    odd: set[str] = field(default_factory=set, compare=False)
    telling: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    @cached_property
    def starts(self) -> frozenset[str]:
        """What entries begin with: most words don't."""
        return frozenset(n.removesuffix("-")[:3] for n in self.names)

    def restore(self, stretch: str) -> str:
        """The likeliest reading of one suspicious stretch (lower case), words parted by blanks."""
        if (read := self.known.get(stretch)) is None:
            read = self._viterbi(stretch)
            if len(stretch) <= SHORT:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[stretch] = read
        return read

    def _viterbi(self, s: str) -> str:
        # state: the last two letters of the reading -> (cost, reading as a linked list)
        states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
        step: dict[tuple[str, str], float] = {}

        def lm(context: str, letter: str) -> float:
            k = (context, letter)
            if k not in step:
                step[k] = self._cost(context, letter)
            return step[k]

        for ch in s:
            nxt: dict[str, tuple[float, tuple]] = {}

            def offer(state: str, cost: float, path: tuple) -> None:
                if state not in nxt or cost < nxt[state][0]:
                    nxt[state] = (cost, path)

            letters = LEET.get(ch, ch if ch.isalpha() else "")
            for state, (cost, path) in states.items():
                for x in letters:
                    offer(state[1] + x, cost + lm(state, x) + (SWAP if x != ch else 0), (path, x))
                if ch == state[1]:
                    offer(state, cost + REPEAT, path)  # once more the same letter
                if ch.isalpha():
                    continue
                if ch == "*":
                    for x in "aeiou":
                        offer(state[1] + x, cost + lm(state, x) + 2 * SWAP, (path, x))
                offer(state, cost + (DROP if ch in SEPARATORS else DECORATION), path)
                if ch in SEPARATORS and state != "^^":
                    offer("^^", cost + lm(state, "$") + SPLIT_COST, (path, " "))
            states = nxt or states
        best = min(((cost + self._cost(state, "$") if state != "^^" else cost, _spell(path)) for state, (cost, path) in states.items()))
        return best[1]

    def _cost(self, context: str, letter: str) -> float:
        g = self.grams
        if (c := g.get(context + letter)) is not None:
            return c
        if (c := g.get(context[1] + letter)) is not None:
            return c + 1.0
        return g.get(letter, 12.0) + 2.0

    def restored_text(self, text: str) -> str:
        """The whole text in lower case, suspicious stretches restored."""
        return self._read(text)[0]

    def _read(self, text: str) -> tuple[str, list[str], set[str]]:
        """(restored text, its tokens, its distinct tokens)."""
        low = text.lower()
        tokens = low.split()
        distinct = set(tokens)
        self._meet(distinct)
        # spelled out with blanks, at least two tokens of one character follow one another
        if self.odd.isdisjoint(distinct) and b"\1\1" not in bytes([len(t) == 1 for t in tokens]):
            return low, tokens, distinct
        out, last = [], 0
        for a, b in suspicious(low):
            out += [low[last:a], self.restore(low[a:b])]
            last = b
        if not out:
            return low, tokens, distinct
        restored = "".join([*out, low[last:]])
        tokens = restored.split()
        distinct = set(tokens)
        self._meet(distinct)
        return restored, tokens, distinct

    def _meet(self, distinct: set[str]) -> None:
        """Judges tokens that weren't met before: whether they are suspicious, and what lexicon entries they hold."""
        new = distinct.difference(self.seen)
        if len(self.seen) + len(new) > CACHED or len(self.odd) + len(self.telling) > CACHED:
            for held in (self.seen, self.odd, self.telling):
                held.clear()
            new = distinct
        for t in new:
            if len(t) <= SHORT:
                self.seen.add(t)
            if THRICE.search(t) and _core(t) if t.isalpha() else INNER.search(t) or _core(t):
                self.odd.add(t)
            if found := tuple(f for w in WORD.findall(t) if w[:3] in self.starts for f in _forms(w) if f in self.names):
                self.telling[t] = found

    def hits(self, tokens: list[str], distinct: set[str]) -> list[str]:
        """Lexicon features of a restored text, as ``entry>=n``."""
        counts: Counter[str] = Counter()
        for t in distinct & self.telling.keys():
            n = tokens.count(t)
            for e in self.telling[t]:
                counts[e] += n
        return sorted(f for e, n in counts.items() for k in LEVELS if n >= k and (f := f"{e}>={k}") in self.lexicon)

    def forget(self) -> None:
        """Drops what was kept: workers are used again by other stages."""
        for held in (self.known, self.seen, self.odd, self.telling):
            held.clear()

    def score(self, text: str | None) -> tuple[float, list[str], str]:
        """(score, lexicon features found, restored text)."""
        restored, tokens, distinct = self._read(text or "")
        if not self.lexicon:
            return self.prior, [], restored
        found = self.hits(tokens, distinct)
        z = self.bias + sum(self.lexicon[w] for w in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found, restored


def _forms(word: str) -> list[str]:
    """The word, and its beginnings (with a dash) of the lengths that stems have."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) >= k)]


def _spell(path: tuple) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def _core(token: str) -> str:
    """What of a token is suspicious, without its edges; empty if nothing is."""
    core = token.strip(EDGE)
    # a trailing run of one sign is decoration, as are signs without letters
    if len(core) > 1 and core[-1] in "!$|+*" and (core[-1] == core[-2] or not core[:-1].isalpha() or core[-1] == "!"):
        core = core.rstrip("!$|+*")
    return core if (SIGN.search(core) or THRICE.search(core)) and any(c.isalpha() for c in core) else ""


def suspicious(low: str) -> list[tuple[int, int]]:
    """Non-overlapping stretches, ascending; linear in the text."""
    found = [m.span() for m in SPELLED.finditer(low)]
    for pattern in (SIGN, THRICE):
        at = 0
        while m := pattern.search(low, at):
            # the token around the sign
            gap = GAP.search(low, m.end())
            end = gap.start() if gap else len(low)
            start = m.start()
            while start > at and not low[start - 1].isspace():
                start -= 1
            at = end
            if core := _core(low[start:end]):
                a = low.index(core, start)
                found.append((a, a + len(core)))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _trigrams(words: Counter[str]) -> Counter[str]:
    """Counts of three letters in a row; ^^ stands before a word and $ after it."""
    tri: Counter[str] = Counter()
    for w, n in words.items():
        padded = f"^^{w}$"
        for i in range(2, len(padded)):
            tri[padded[i - 2 : i + 1]] += n
    return tri


@lru_cache(1)
def _is_letter() -> np.ndarray:
    """For each code point, whether WORD takes it."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


def _trigram_codes(texts: list[str]) -> pd.Series:
    """As _trigrams, for the words of texts: counts by the three code points, 21 bits each."""
    points = code_points("\n\n" + "\n".join(t.lower() for t in texts) + "\n").astype(np.int64)
    letter = _is_letter()[points]
    at = np.flatnonzero(letter[2:] | letter[1:-1]) + 2  # letters, and the first character after a word
    third = np.where(letter[at], points[at], ord("$"))
    second = np.where(letter[at - 1], points[at - 1], ord("^"))
    first = np.where(letter[at - 1] & letter[at - 2], points[at - 2], ord("^"))
    return pd.Series(first << 42 | second << 21 | third).value_counts(sort=False)


def count_trigrams(docs: DataFrame, text: str = "text") -> Counter[str]:
    """Trigrams of the words of all whole texts, summed up per task and then by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri: Counter[int] = Counter()
        for batch in batches:
            for _, own in slices(t.as_py() for t in batch.column(0)):
                found = _trigram_codes(own)
                tri.update(dict(zip(found.index.tolist(), found.tolist())))
        if tri:
            grams = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in tri]
            yield pa.RecordBatch.from_pydict({"gram": grams, "n": list(tri.values())})

    found = docs.select(text).mapInArrow(tidy(run), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counter({r[0]: r[1] for r in found.collect()})


def _character_model(seen: Counter[str], boost: list[str]) -> dict[str, float]:
    """Costs (negative log probabilities) of letters after two, one and no letters, from trigram counts."""
    total = sum(n for g, n in seen.items() if g[2] == "$")
    tri = seen + _trigrams(Counter({w: max(1, total // (4 * len(boost))) for w in boost}))
    two, bi, one, uni = Counter(), Counter(), Counter(), Counter()
    for g, n in tri.items():
        two[g[:2]] += n
        bi[g[1:]] += n
        one[g[1]] += n
        uni[g[2]] += n
    total = sum(uni.values()) or 1
    grams = {k: -math.log(n / total) for k, n in uni.items()}
    grams |= {k: -math.log(n / one[k[0]]) for k, n in bi.items()}
    grams |= {k: -math.log(n / two[k[:2]]) for k, n in tri.items()}
    return grams


def _features(text: str, among: set[str] | None = None) -> set[str]:
    counts: Counter[str] = Counter()
    for w in WORD.findall(text.lower()):
        counts.update(_forms(w) if among is None else [f for f in _forms(w) if f in among])
    return {f"{f}>={k}" for f, n in counts.items() for k in LEVELS if n >= k}


def fit(texts: list[str], labels: list[int], counts: dict[int, int], trigrams: Counter[str], least_gain: float = 0.01, most: int = MOST_ENTRIES) -> Model:
    """Greedy cover of the toxic texts by lexicon features, then a logistic fit of their weights; trigrams: of the corpus."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(set(labels)) < 2:
        return Model(prior, grams=_character_model(trigrams, []))
    pos, neg = [t for t, y in zip(texts, labels) if y == 1], [t for t, y in zip(texts, labels) if y != 1]
    n1, n0 = len(pos), len(neg)
    forms: Counter[str] = Counter()
    for t in pos:
        forms.update({f for w in set(WORD.findall(t.lower())) for f in _forms(w)})
    often = {f for f, n in forms.items() if n >= max(3, least_gain * n1)}
    toxic, clean = [_features(t, often) for t in pos], [_features(t, often) for t in neg]
    df1, df0 = Counter(f for b in toxic for f in b), Counter(f for b in clean for f in b)
    odds = {f: math.log((n + 0.5) / (n1 + 1)) - math.log((df0[f] + 0.5) / (n0 + 1)) for f, n in df1.items() if n >= max(3, least_gain * n1)}
    odds = {f: o for f, o in odds.items() if o > 1.5}
    chosen: list[str] = []
    where: dict[str, list[int]] = {}
    for i, b in enumerate(toxic):
        for f in b & odds.keys():
            where.setdefault(f, []).append(i)
    # each toxic text wants to be explained twice, so that one entry's absence doesn't decide
    want = [2] * n1
    gain = {f: 2 * len(w) for f, w in where.items()}
    while gain and len(chosen) < most:
        f = min(gain, key=lambda f: (-gain[f] * odds[f], -len(f), f))
        if gain[f] < max(3, least_gain * n1):
            break
        chosen.append(f)
        del gain[f]
        for i in where[f]:
            if want[i]:
                want[i] -= 1
                for g in toxic[i] & gain.keys():
                    gain[g] -= 1
    # words that explain as many texts as the chosen entries typically do belong to the lexicon too
    if chosen:
        usual = sorted(df1[f] for f in chosen)[len(chosen) // 2]
        extra = [f for f in odds if f.endswith(">=1") and "-" not in f and df1[f] >= 0.4 * usual and odds[f] > 3 and f not in chosen]
        chosen += sorted(extra, key=lambda f: (-df1[f], f))[: most - len(chosen)]
    place = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((n1 + n0, len(chosen) + 1))
    x[:, -1] = 1
    for i, b in enumerate([*toxic, *clean]):
        x[i, [place[f] for f in b & place.keys()]] = 1
    y = np.concatenate([np.ones(n1), np.zeros(n0)])
    weight = np.concatenate([np.full(n1, prior / n1), np.full(n0, (1 - prior) / n0)])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-5)
    ridge[-1] = 1e-9
    for _ in range(30):  # damped Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    # an entry that hardly occurs in other texts is evidence enough by itself, however often others explain its texts
    for f, i in place.items():
        if odds[f] > 4:
            w[i] = max(w[i], min(8.0, odds[f]))
    names = frozenset(f.partition(">=")[0] for f in chosen)
    words = {v for t in texts for v in WORD.findall(t.lower())}
    heavy = [v for v in words if len(v) > 2 and any(f in names for f in _forms(v))]
    return Model(prior, {f: float(w[i]) for f, i in place.items()}, float(w[-1]), _character_model(trigrams, sorted(heavy)), names)


def train_model(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on labelled rows where ``use`` holds; by default crc32(key) mod 4 is not 2.  Letters are counted in all rows."""
    use = F.crc32(F.col(key).cast("string")) % 4 != 2 if use is None else use
    rows, counts = labelled_texts(docs, labels, label, use, key, text, per_class)
    return fit_restored([t for t, _ in rows], [y for _, y in rows], counts, count_trigrams(docs, text))


def fit_restored(texts: list[str], labels: list[int], counts: dict[int, int], trigrams: Counter[str]) -> Model:
    """Fits twice: what is learnt from the texts as they are restores them, and the lexicon is learnt anew from that."""
    first = fit(texts, labels, counts, trigrams)
    if not first.lexicon:
        return first
    return fit([first.restored_text(t) for t in texts], labels, counts, trigrams)


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", restored: bool = False) -> DataFrame:
    """(key, score, hits[, restored]) of every row."""
    rows = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_CLASS and the alphabets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        try:
            yield from score(m, batches)
        finally:
            m.forget()

    def score(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, hits, read = [], [], []
            for t in batch.column(1):
                s, h, r = m.score(t.as_py())
                scores.append(s)
                hits.append(h)
                if restored:
                    read.append(r)
            columns = {key: batch.column(0), "score": pa.array(scores, pa.float64()), "hits": pa.array(hits, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns | ({"restored": pa.array(read, pa.string())} if restored else {}))

    return rows.mapInArrow(tidy(run), f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, hits array<string>" + (", restored string" if restored else ""))

"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Candidates: the base patterns (email, ip, card, phone) and looser ones
   (written-out emails, national phone numbers, ssn, iban, secrets: keys of known
   shapes and values that a name such as token or password is set to).
2. Labelers (regular expressions, gazetteers, context) vote +1, -1 or 0 on
   each candidate.  Votes and span features are discrete, so the corpus is
   summed up exactly by counts of (kind, votes, features): all documents
   count, and only distinct combinations, whose number the labelers bound,
   reach the driver.
3. Expectation-maximisation of a naive two-class model of the votes estimates
   each labeler's reliability and each combination's probability.
4. A logistic span classifier is trained on the features (not the votes) with
   these probabilities as soft labels.  Candidates of the looser patterns that
   it scores at 0.5 or more become spans; base spans stay whatever it says.

Positions are code points, ends exclusive.  Base patterns are taken leftmost
and non-overlapping per kind; failing matches (parts of an ip over 255, card
numbers not of 13 to 19 digits or failing Luhn, phones not of 9 to 15 digits)
are dropped without a retry.  All scans are linear in the text.

Defined results: null and empty texts have no spans and an empty redacted
text; rows with null keys and repeated rows are each judged; a span found twice
counts once; other columns are only carried if named; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import tidy

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE_KINDS = KINDS[:4]
DIGITS = frozenset("0123456789")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
AT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}) ?| at ", re.IGNORECASE)
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot |\.)[A-Za-z0-9-]++)+", re.IGNORECASE)
WRITTEN_DOT = re.compile(r"[\[({ ]dot[\])} ]", re.IGNORECASE)
#: A name of something secret, before the sign that sets it, and what it is set to.
NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|passphrase|credentials?|(?:api|access|private|auth)[_-]?key)[\"']?\s{0,8}\Z", re.IGNORECASE)
LONGEST_NAME = 32
SIGN = re.compile(r"[:=]")
VALUE = re.compile(r"\s{0,8}[\"']?([A-Za-z0-9+/_=.~!@#$%^&*-]{8,}+)")
BEARER = re.compile(r"earer\s([A-Za-z0-9+/_=.~-]{20,}+)")
#: Keys whose issuers give them a recognisable beginning.
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])")
#: What keys look like that nothing else tells: long hexadecimal, or letters of both cases with digits.
KEY = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_=-]{16,}")
BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk-", "k_live_", "AIza", "glpat-", "eyJ")
PEM = re.compile(r"-----BEGIN (?:[A-Z]++ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]++ )*PRIVATE KEY-----)?")
DIGIT_OR_AT = re.compile(r"[0-9@]")
#: Country codes of domains, and the more common of the others.
TLDS = frozenset(
    """ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw
    cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu id ie il im in io
    iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my
    mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv
    sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw com org net edu gov mil int info biz
    name pro mobi jobs travel museum coop aero asia cat tel post xxx app dev page blog cloud online site store shop tech xyz club live news email agency
    digital media design studio solutions services systems software world group team work life today guru art bank law""".split()
)
#: Beginnings of international telephone numbers: countries, and groups of ten where most of them are in use.
CALLING = tuple(
    """1 7 20 27 211 212 213 216 218 22 23 24 25 26 290 291 297 298 299 30 31 32 33 34 35 36 37 38 39 40 41 420 421 423 43 44 45 46 47 48 49 50 51 52 53 54 55
    56 57 58 59 60 61 62 63 64 65 66 67 68 69 800 808 81 82 84 850 852 853 855 856 86 870 878 880 881 882 883 886 888 90 91 92 93 94 95 96 97 98 99""".split()
)
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PL": 28, "PT": 25, "SE": 24, "DK": 18, "FI": 18, "NO": 15, "IE": 22, "LU": 20}
CUES = re.compile(r"mail|contact|tel|phone|call|fax|mobile|card|visa|iban|account|ssn|social|address|adresse|correo|courriel|write|reach|kontakt|konto|token|secret|passw|key|\bip\b", re.IGNORECASE)
ANTI_CUES = re.compile(r"(?:version|\bv|figure|fig\.|page|chapter|isbn|order|build|release|section|\bno\.|#|\bid)[ :=]*$", re.IGNORECASE)
CONTEXT = 30
N_VOTES, N_FEATURES = 7, 5
POOLED = 20.0


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    features: tuple[int, ...]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, holds) of the base patterns' matches."""
    at, floor = text.find("@"), 0
    while at >= 0:
        own = text[floor:at]
        start = floor + len(own.rstrip(LOCAL))
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end(), True
            floor = m.end()
        at = text.find("@", floor)
    for m in IP.finditer(text):
        yield "ip", *m.span(), all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            yield "card", *m.span(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= len(_digits(m.group())) <= 15


def loose_matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Written-out emails, national phone numbers, ssn, iban and secrets."""
    low = 0
    for m in AT.finditer(text):
        own = text[low : m.start()]  # no local part reaches beyond the "at" before it
        start = m.start() - (len(own) - len(own.rstrip(LOCAL)))
        low = m.end()
        d = WRITTEN_DOMAIN.match(text, m.end())
        if d and start < m.start() and (m.group() != " at " or WRITTEN_DOT.search(d.group())):
            low = d.end()
            yield "email", start, d.end()
    for kind, pattern in (("phone", NATIONAL), ("ssn", SSN), ("iban", IBAN)):
        for m in pattern.finditer(text):
            yield kind, *m.span()
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            yield "secret", *m.span()
    if any(b in text for b in BEGINNINGS):
        for m in ISSUED.finditer(text):
            if not DIGITS.isdisjoint(m.group()):
                yield "secret", *m.span()
    values = (VALUE.match(text, m.end()) for m in SIGN.finditer(text) if NAMED.search(text, max(0, m.start() - LONGEST_NAME), m.start()))
    for m in (*values, *BEARER.finditer(text)):
        value = m.group(1).rstrip(".!") if m else ""
        if len(value) >= 8 and not DIGITS.isdisjoint(value) and any(c.isalpha() for c in value):
            yield "secret", m.start(1), m.start(1) + len(value)


def _judge(text: str, kind: str, start: int, end: int, base: bool, shape: bool) -> Candidate:
    """Votes and features of one candidate; shape: it fits its kind's base pattern."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT) : start]
    strict = 1 if base else -1 if shape else 0
    strong = {"email": bool(re.search(r"@|[\[({]", span)), "phone": span[0] in "+(", "ssn": True, "iban": True, "ip": False, "card": " " in span or "-" in span, "secret": len(span) >= 16}[kind]
    listed = False
    if kind == "email":
        listed = span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower().strip("])}") in TLDS
    elif kind == "phone":
        listed = span[0] != "+" or digits.startswith(CALLING)
    elif kind == "card":
        listed = digits[:1] in ("3", "4", "5", "6")
    elif kind == "ip":
        listed = not digits.startswith("0")
    elif kind == "ssn":
        listed = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    elif kind == "iban":
        c = span.replace(" ", "")
        listed = IBAN_LENGTH.get(c[:2]) == len(c) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    elif kind == "secret":
        listed = bool(ISSUED.match(span) or PEM.match(span) or KEY.fullmatch(span))
    cue, anti = bool(CUES.search(before)), bool(ANTI_CUES.search(before))
    clear = not (text[start - 1 : start] if start else "").isalnum() and not text[end : end + 1].isalnum()
    varied = span[0].isalpha() if kind == "email" else len(set(span)) > 5 if kind == "secret" else len(set(digits)) > 2
    votes = (strict, int(strong), 1 if listed else -1, int(cue), -1 if anti else 0, 1 if clear else -1, 1 if varied else -1)
    features = (int(base), int(strong), int(listed), int(clear), int(cue and not anti))
    return Candidate(kind, start, end, base, votes, features)


def may_hold(text: str) -> bool:
    """Whether a text has anything that some candidate holds, told by cheap searches: false means that it has none."""
    if DIGIT_OR_AT.search(text) or "-----BEGIN " in text or " AT " in text or " At " in text or " aT " in text:
        return True
    low = text.lower()
    return "[at]" in low or "(at)" in low or "{at}" in low or "dot" in low and bool(WRITTEN_DOT.search(text))


def candidates(text: str | None) -> list[Candidate]:
    """Candidates of a whole text; looser ones that touch a base span, or an earlier loose one, are left out."""
    if not text or not may_hold(text):
        return []
    out = [_judge(text, k, a, b, holds, True) for k, a, b, holds in base_matches(text)]
    taken = sorted((c.start, c.end) for c in out if c.base)
    loose = sorted(set(loose_matches(text)), key=lambda x: (x[1], -x[2], x[0]))
    i = last = 0
    for kind, a, b in loose:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            out.append(_judge(text, kind, a, b, False, False))
            last = b
    return out


# -- the model ----------------------------------------------------------------


def _pattern(c: Candidate) -> str:
    return f"{c.kind}|{','.join(map(str, c.votes))}|{','.join(map(str, c.features))}"


@dataclass(frozen=True)
class Model:
    """reliability[kind][labeler]: its estimated accuracy when it votes on a kind; weights: of the span classifier."""

    reliability: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]

    def score(self, c: Candidate) -> float:
        x = _design(c.kind, c.features)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ np.array(self.weights))))))


def _design(kind: str, features: tuple[int, ...]) -> np.ndarray:
    return np.array([1.0, *(kind == k for k in KINDS), *features])


def fit(counts: dict[str, int], rounds: int = 50, steps: int = 300) -> Model:
    """EM over counted vote combinations, then the span classifier on soft labels.

    A labeler's reliability on a kind is smoothed by ``POOLED`` pseudo-votes of
    its reliability on all kinds, and that by ten of 0.8, so that few or no
    candidates leave a majority-like vote; labelers are taken to be better than
    chance.  A kind's share of true candidates is smoothed alike.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    split = [k.split("|") for k in keys]
    votes = np.array([[int(v) for v in s[1].split(",")] for s in split]).reshape(len(keys), N_VOTES)
    own = np.array([[s[0] == k for k in KINDS] for s in split], dtype=float).reshape(len(keys), len(KINDS))
    right, prior = np.full((len(KINDS), N_VOTES), 0.8), np.full(len(KINDS), 0.5)
    p = np.zeros(len(keys))
    for _ in range(rounds):
        odds = own @ np.log(prior / (1 - prior)) + (votes * (own @ np.log(right / (1 - right)))).sum(1)
        p = 1 / (1 + np.exp(-odds))
        agree = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0)) * n[:, None]
        cast = (votes != 0) * n[:, None]
        pooled = (agree.sum(0) + 8) / (cast.sum(0) + 10)
        right = np.clip((own.T @ agree + POOLED * pooled) / (own.T @ cast + POOLED), 0.55, 0.99)
        share = ((n * p).sum() + 5) / (n.sum() + 10)
        prior = np.clip((own.T @ (n * p) + POOLED * share) / (own.T @ n + POOLED), 0.05, 0.95)
    x = np.array([_design(s[0], tuple(map(int, s[2].split(",")))) for s in split]).reshape(len(keys), 1 + len(KINDS) + N_FEATURES)
    # pseudo-rows keep the classifier sane where a feature was never seen
    x = np.vstack([x, *[[_design(k, (0,) * N_FEATURES), _design(k, (1,) * N_FEATURES)] for k in KINDS]])
    y = np.concatenate([p, np.tile([0.1, 0.9], len(KINDS))])
    m = np.concatenate([n, np.ones(2 * len(KINDS))])
    m = m / m.sum() * 0.5 + 0.5 / len(m)
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # damped Newton
        q = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (m * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (m * (q - y)) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return Model(tuple(map(tuple, right.tolist())), tuple(w.tolist()))


def fit_corpus(docs: DataFrame, text: str = "text") -> Model:
    """Counts vote combinations over all documents (pre-aggregated per batch) and fits on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0):
                seen.update(map(_pattern, candidates(t.as_py())))
            if seen:
                yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())})

    found = docs.select(text).mapInArrow(tidy(run), "pattern string, n bigint").groupBy("pattern").agg({"n": "sum"})
    return fit({r[0]: r[1] for r in found.collect()})


def spans_of(text: str | None, model: Model) -> list[Candidate]:
    found = {(c.kind, c.start, c.end): c for c in candidates(text) if c.base or (c.votes[0] == 0 and model.score(c) >= 0.5)}
    return sorted(found.values(), key=lambda c: (KINDS.index(c.kind), c.start, c.end))


def redact_text(text: str | None, spans: list[Candidate]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the leftmost, then longest, names the union."""
    out, last, union = [], 0, 0
    for c in sorted(spans, key=lambda c: (c.start, -c.end)):
        if c.start >= union:
            out += [text[last : c.start] if c.start > last else "", f"[{c.kind.upper()}]"]
            last = c.end
        union = max(union, c.end)
        last = max(last, union)
    return "".join(out) + (text or "")[last:]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", redact: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, spans[, redacted][, carried columns]): spans by kind, then start.

    Two map-only passes over the texts (one if a model is given) and a shuffle
    of vote counts.
    """
    model = model or fit_corpus(docs, text)
    rows = docs.select(key, text, *carry)
    extra = [(c, rows.schema[c].dataType.simpleString()) for c in carry]
    schema = ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", f"spans {SPANS}", *(["redacted string"] if redact else []), *(f"`{c}` {t}" for c, t in extra)])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for t in batch.column(1):
                t = t.as_py()
                found = spans_of(t, model)
                spans.append([{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base} for c in found])
                if redact:
                    clean.append(redact_text(t, found) if found else t or "")
            columns = {key: batch.column(0), "spans": pa.array(spans, span_type)}
            if redact:
                columns["redacted"] = pa.array(clean, pa.string())
            for i, (c, _) in enumerate(extra):
                columns[c] = batch.column(2 + i)
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(tidy(run), schema)

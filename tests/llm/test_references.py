"""Models and searches against slow references, without Spark."""

import itertools
import math
import random
import re
import struct
import unicodedata
from collections import Counter

import numpy as np
import pytest


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "re", "ti", "on", "er", "be"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


# 2 -----------------------------------------------------------------------------


def naive_evidence(text, model):
    """Per bit: the mean log odds of the grams at each letter and after it, times the evidence believed."""
    from graphloom.llm.lang_id import EVIDENCE

    letter = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
    seq = [0, 0, *map(letter, text)]
    mask, total, n = (1 << 32) - 1, np.zeros(model.codes.shape[1]), 0
    for p2, p1, c in zip(seq, seq[1:], seq[2:]):
        if not (c or p1):
            continue
        n += 1
        one = (c * 2654435761 & mask) >> 17
        two = (((c * 2246822519 & mask) ^ (p1 * 3266489917 & mask)) * 668265263 & mask) >> 17
        three = (((c * 374761393 & mask) ^ (p1 * 2246822519 & mask) ^ (p2 * 3266489917 & mask)) * 2654435761 & mask) >> 17
        total += model.table[0][one].astype(float) + model.table[1][two] + model.table[2][three]
    return total / max(n, 1) * min(n, EVIDENCE)


def test_language_margins_and_decoding(monkeypatch):
    from graphloom.llm import lang_id

    rng = random.Random(20)
    make = {"a": "abc ", "b": "bcd ", "c": "cdé ", "d": "dßñ "}
    rows = [("".join(rng.choice(make[k]) for _ in range(80)), k) for k in make for _ in range(20)]
    model = lang_id.fit([t for t, _ in rows], [k for _, k in rows])
    texts = ["", "12 !", "Abc dé", "x" * 3000, *("".join(rng.choice("abcdéßñ Q1") for _ in range(rng.randrange(200))) for _ in range(30))]
    for cells in (1 << 21, 7 << 10):  # the latter cuts long texts into pieces
        monkeypatch.setattr(lang_id, "CELLS", cells)
        margin, lettered = model.margins(texts)
        for t, m, ok in zip(texts, margin, lettered):
            assert ok == any(map(str.isalpha, t))
            assert np.allclose(m, naive_evidence(t, model), atol=1e-3)
    told, score, _ = model.predict(texts)
    for t, m, name, p in zip(texts, margin, told, score):
        if not any(map(str.isalpha, t)):
            assert (name, p) == ("und", 0)
            continue
        loss = [sum(w * math.log1p(math.exp(-b * x)) for w, b, x in zip(model.bit_weights, code, m)) for code in model.codes]
        likely = [math.exp(min(loss) - x) for x in loss]
        assert name == model.languages[likely.index(max(likely))] and abs(p - max(likely) / sum(likely)) < 1e-6


def test_letters_of_all_planes():
    from graphloom.llm.lang_id import fit

    model = fit(["ab", "cd"], ["x", "y"])
    told = model.predict(["\U00030000\U00030001", "\U000e0041 \U000f0000", "𝒜"])[0]
    assert told[0] != "und" and told[1] == "und" and told[2] != "und"


def test_many_languages_and_a_long_text_need_little_memory():
    import tracemalloc

    from graphloom.llm.lang_id import fit

    langs = [chr(ord("a") + i) for i in range(7)]
    model = fit([x * 30 for x in langs], langs)
    text = "abc défg " * 500_000
    tracemalloc.start()
    model.predict([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.codes.shape[1] == 63 and most < 150e6


# 3 -----------------------------------------------------------------------------


def test_plans_of_many_shards_are_linear_and_whole():
    import time

    from graphloom.llm.sharding import Shard, plan_merges, tier

    rng = random.Random(21)
    shards = [Shard(f"s{i}", f"p{i}", 1, rng.choice([10, 100, 1000, 5000]), i, i) for i in range(40_000)]
    began = time.time()
    groups = plan_merges(shards, target=100_000, fan_in=4)
    assert time.time() - began < 10
    seen = [s.name for g in groups for s in g]
    assert len(seen) == len(set(seen))
    merged = [sum(s.bytes for s in g) for g in groups]
    left = [s.bytes for s in shards if s.name not in set(seen)]
    tiers = Counter(tier(b, 100_000, 4) for b in merged + left)
    assert all(n < 4 for k, n in tiers.items() if k < 0)


# 4 -----------------------------------------------------------------------------


def semi_global(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("m", [1, 5, 9, 10, 19, 20, 29, 35, 50, 69, 99, 109, 150, 200])
def test_budget_of_every_length(m):
    from graphloom.llm.decontaminate import Item, Matcher, budget, normal

    rng = random.Random(m)
    assert budget(m) == m // 10
    base = normal(words(rng, 80))[:m].replace(" ", "x")
    item = Item(1, base)
    assert sum(item.share) == item.k + 1 == len(list(item.pieces())) and "".join(p for p, _, _ in item.pieces()) == base
    matcher = Matcher([(1, base)])
    for _ in range(25):
        edited = list(base)
        for _ in range(rng.randrange(0, item.k + 3)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
        text = normal(rng.choice(["", "ab ", "ab"]) + "".join(edited) + rng.choice(["", " yz", "yz"]))
        d = semi_global(base, text)
        got = matcher.find(text)
        assert [x[3] for x in got] == ([d] if d <= item.k else [])


# 5 -----------------------------------------------------------------------------


def test_spans_have_no_longest_length():
    from graphloom.llm.pii import candidates

    local, host = "a" * 300, " dot ".join(["b"] * 12)
    text = f"{local} at {host} (dot) com"
    assert [(c.kind, c.start, c.end) for c in candidates(text)] == [("email", 0, len(text))]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
        ("api_key: 'AbCd1234EfGh5678IjKl'", "AbCd1234EfGh5678IjKl"),
        ("PASSWORD=hunter22x.", "hunter22x"),
        ("use ghp_" + "a1B2" * 9 + " now", "ghp_" + "a1B2" * 9),
        ("-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"),
        ("the token is required: please ask", None),
        ("a secret ingredient = sugarandspice", None),
    ],
)
def test_secrets(text, value):
    from graphloom.llm.pii import Model, candidates, fit, redact_text, spans_of

    found = [text[c.start : c.end] for c in candidates(text) if c.kind == "secret"]
    assert found == ([value] if value else [])
    model = fit({})
    assert isinstance(model, Model)
    if value and len(value) > 12:
        assert "[SECRET]" in redact_text(text, spans_of(text, model))


def test_em_against_a_plain_one():
    from graphloom.llm.pii import KINDS, N_VOTES, POOLED, fit

    rng = random.Random(22)
    counts = Counter()
    for _ in range(400):
        kind, real = rng.choice(["email", "ip"]), rng.random() < 0.6
        votes = [0 if rng.random() < 0.2 else (1 if real == (rng.random() < 0.85) else -1) for _ in range(N_VOTES)]
        counts[f"{kind}|{','.join(map(str, votes))}|0,{int(real)},1,1,0"] += 1
    got = fit(dict(counts), rounds=30).reliability
    rows = [(k.split("|")[0], [int(v) for v in k.split("|")[1].split(",")], n) for k, n in sorted(counts.items())]
    right = {k: [0.8] * N_VOTES for k in KINDS}
    prior = dict.fromkeys(KINDS, 0.5)
    for _ in range(30):
        p = []
        for kind, votes, _ in rows:
            yes, no = prior[kind], 1 - prior[kind]
            for v, r in zip(votes, right[kind]):
                if v:
                    yes *= r if v > 0 else 1 - r
                    no *= 1 - r if v > 0 else r
            p.append(yes / (yes + no))
        agree = lambda j, kind=None: sum(n * (q if v[j] > 0 else 1 - q) for (k, v, n), q in zip(rows, p) if v[j] and kind in (None, k))  # noqa: E731, B023
        cast = lambda j, kind=None: sum(n for k, v, n in rows if v[j] and kind in (None, k))
        pooled = [(agree(j) + 8) / (cast(j) + 10) for j in range(N_VOTES)]
        total = sum(n for *_, n in rows)
        share = (sum(n * q for (*_, n), q in zip(rows, p)) + 5) / (total + 10)
        for kind in KINDS:
            right[kind] = [min(0.99, max(0.55, (agree(j, kind) + POOLED * pooled[j]) / (cast(j, kind) + POOLED))) for j in range(N_VOTES)]
            own = [(n, q) for (k, _, n), q in zip(rows, p) if k == kind]
            prior[kind] = min(0.95, max(0.05, (sum(n * q for n, q in own) + POOLED * share) / (sum(n for n, _ in own) + POOLED)))
    assert np.allclose(got, [right[k] for k in KINDS], atol=1e-9)


# 6 -----------------------------------------------------------------------------


def test_footrule_of_postings():
    from graphloom.llm.ann import Shard, nearest_pivots

    rng = np.random.default_rng(23)
    pivots, rows, query = rng.normal(size=(12, 5)), rng.normal(size=(30, 5)), rng.normal(size=(1, 5))
    prefix = 4
    order, own = nearest_pivots(rows, pivots, prefix), nearest_pivots(query, pivots, prefix)[0]
    far = Shard(rows, pivots, prefix).footrule(own)
    place = lambda seq, p: list(seq).index(p) if p in seq else prefix
    for i in range(30):
        assert far[i] == sum(abs(place(order[i], p) - place(own, p)) for p in {*order[i], *own})


# 7 -----------------------------------------------------------------------------


def test_gradient_against_differences():
    from graphloom.llm import quality

    rng = np.random.default_rng(24)
    first = np.array([0, 1, 4, 6])
    x, y, each = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    w = {"E": rng.normal(size=(5, 3)), "e": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}
    told = quality.gradient(w, x, first, y, each)
    for k, value in w.items():
        for at in np.ndindex(value.shape):
            was, step = value[at], 1e-5
            value[at] = was + step
            up = quality.loss(w, x, first, y, each)
            value[at] = was - step
            down = quality.loss(w, x, first, y, each)
            value[at] = was
            assert abs((up - down) / (2 * step) - told[k][at]) < 1e-7


def test_attention_of_each_document_alone():
    from graphloom.llm import quality

    rng = random.Random(25)
    texts = [words(rng, n) for n in (1, 63, 64, 65, 400)] + ["", "!!! ###"]
    labels = [0, 1, 0, 1, 1, 0, 0]
    model = quality.fit(texts, labels, 0.5, steps=20)
    together = model.score(texts)
    w = model.weights
    for t, s in zip(texts, together):
        x = (quality.passages([t])[0] - w["mean"]) / w["std"]
        h = np.tanh(x @ w["E"] + w["e"])
        logit = (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]
        share = np.exp(logit) / np.exp(logit).sum()
        assert abs(1 / (1 + np.exp(-((share @ h) @ w["c"] + w["d"][0]))) - s) < 1e-9


# 8 -----------------------------------------------------------------------------


def readings(s):
    """Every path through the lattice of a stretch: (channel cost, reading)."""
    from graphloom.llm.toxicity import DECORATION, DROP, LEET, REPEAT, SEPARATORS, SPLIT_COST, SWAP

    paths = [(0.0, "")]
    for ch in s:
        new = []
        for cost, read in paths:
            new += [(cost + (SWAP if x != ch else 0), read + x) for x in LEET.get(ch, ch if ch.isalpha() else "")]
            if read and read[-1] == ch and ch.isalpha():
                new.append((cost + REPEAT, read))
            if ch.isalpha():
                continue
            if ch == "*":
                new += [(cost + 2 * SWAP, read + x) for x in "aeiou"]
            new.append((cost + (DROP if ch in SEPARATORS else DECORATION), read))
            if ch in SEPARATORS and read and read[-1] != " ":
                new.append((cost + SPLIT_COST, read + " "))
        paths = new
    return paths


def test_viterbi_against_all_readings():
    from graphloom.llm.toxicity import Model, _character_model, _trigrams

    trigrams = _trigrams(Counter("idiot moron scum a is most also solid room mile tame sit".split()))
    model = Model(0.1, grams=_character_model(trigrams, []))

    def cost(channel, read):
        for word in read.split(" "):
            padded = f"^^{word}$" if word else ""
            channel += sum(model._cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))
        return channel

    for s in ["1d10t", "m.o.r.o.n", "sc*m", "sccum", "m0r0n", "a-1s", "so+id", "5it", "ta*e", "!s"]:
        best = min(cost(c, r) for c, r in readings(s))
        told = model._viterbi(s)
        assert min(c for c, r in ((cost(c, r), r) for c, r in readings(s)) if r == told) <= best + 1e-9
    assert model._viterbi("1d10t") == "idiot" and model._viterbi("m.o.r.o.n") == "moron"


def test_tokens_tell_where_stretches_are():
    from graphloom.llm.toxicity import Model, suspicious

    rng = random.Random(26)
    model = Model(0.1)
    for _ in range(20_000):
        low = "".join(rng.choice("ab .-_*~!@1$ xyz  ") for _ in range(rng.randrange(50)))
        tokens = low.split()
        model._meet(set(tokens))
        odd = not model.odd.isdisjoint(tokens) or b"\1\1" in bytes([len(t) == 1 for t in tokens])
        assert odd or not suspicious(low)


def test_disguised_words_are_learnt_as_what_they_stand_for():
    from graphloom.llm.toxicity import _trigrams, fit_restored

    rng = random.Random(27)
    bad = {"idiot": ["idiot", "1d1ot", "id!ot"], "moron": ["moron", "m0ron", "mor0n"]}
    labels = [int(rng.random() < 0.4) for _ in range(300)]
    texts = [words(rng, 30) + (" " + " ".join(rng.choice(v) for v in bad.values()) if y else "") for y in labels]
    trigrams = _trigrams(Counter(w for t in texts for w in re.findall("[a-z]+", t)))
    model = fit_restored(texts, labels, dict(Counter(labels)), trigrams)
    assert {"idiot", "moron"} & {f.partition(">=")[0] for f in model.lexicon}
    assert all(model.score(words(rng, 20) + " " + w)[0] >= 0.3 for w in ("1di0t", "m0r0n", "idiot", "moron"))


# 10 ----------------------------------------------------------------------------


def test_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    from graphloom.llm.bpe import Codec
    from graphloom.llm.queries import tokenizer
    from graphloom.llm.unicode_classes import INERT, code_points

    library, codec = Tokenizer.from_file(tokenizer()), Codec(tokenizer())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng = random.Random(28)
    marks = [c for c in every if unicodedata.combining(c)]
    pools = [marks, sorted(map(chr, code_points(INERT))), [c for c in every if unicodedata.decomposition(c)], every, list("abc 'st!1 "), every[:600]]
    mixed = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for texts in ([f"a{c}b" for c in every], mixed):
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            held = [codec.words(t) for t in part]
            codec.learn(set(itertools.chain.from_iterable(held)))
            for t, own, e in zip(part, held, library.encode_batch(part, add_special_tokens=False)):
                assert b"".join([codec.ids[w] for w in own]) == struct.pack(f"<{len(e.ids)}I", *e.ids), ascii(t)

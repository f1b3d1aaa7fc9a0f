"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word's adjacent symbol pairs are the leaves of a segment tree of minima
over (merge rank, position).  The root is the leftmost pair of lowest rank; it
is merged, the at most three leaves that this changes are updated on their
way up to the root, and so on until the root holds no mergeable pair.  The
trees of all new words of a batch of texts are kept as arrays and advance
together, one merge each per step.

Vocabulary, merges and special tokens are read from a public ``tokenizer.json``
whose path is a parameter: the file must exist at that path on every executor.
Normalisation is NFC, white space to blanks and lower case character by
character; words are split as the file's pattern says, with classes of characters
as the library has them (``unicode_classes``); special tokens are found in the raw text.  Only this family of files is accepted, others raise an error.

Defined results: null and empty texts give no tokens and an empty decoded
text; whole texts of any length are encoded; every row gives one row, repeated
rows too; other columns of the input are not read; an empty table gives an
empty result.  Ids decode as the public library does for a file without a
decoder: the tokens joined by blanks.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import tidy
from graphloom.llm.unicode_classes import INERT, LETTERS, NUMBERS, SMALL, code_points

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = regex.compile(PATTERN.replace(r"\s", WHITE))


@lru_cache(1)
def _strange() -> dict[str, str]:
    """Stand-ins of the code points that the pattern engine here takes for something else than the library does (its
    tables may be newer): a letter, a digit or a sign."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: dict[str, str] = {}
    kinds = ((LETTERS, r"\p{L}", "a"), (NUMBERS, r"\p{N}", "1"))
    held = [(code_points(packed), {ord(c) for c in regex.findall(p, every)}, sign) for packed, p, sign in kinds]
    for own, theirs, _ in held:
        out |= {chr(c): "!" for c in theirs - own}
    for own, theirs, sign in held:
        out |= {chr(c): sign for c in own - theirs}
    return out


@lru_cache(1)
def _inert() -> tuple[frozenset[str], regex.Pattern, dict[str, str]]:
    """Characters that the library's normal form leaves alone, a pattern of them, and small letters it has beyond str.lower."""
    held = frozenset(map(chr, code_points(INERT)))
    small = dict(p.split(":") for p in SMALL.split())
    return held, regex.compile("([" + "".join(sorted(held)) + "])"), {chr(int(a, 16)): chr(int(b, 16)) for a, b in small.items()}


def split_words(text: str) -> list[str]:
    """Words of a text in normal form: NFC, lower case character by character."""
    try:
        text.encode("latin-1")  # nothing there that any tables disagree about, and all of it in NFC
        return SPLIT.findall(text.lower())
    except UnicodeEncodeError:
        used = set(text)
    inert, pattern, small = _inert()
    if not inert.isdisjoint(used):
        text = "".join([unicodedata.normalize("NFC", part) for part in pattern.split(text)])
    elif not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # character by character: no final sigma
    text = text.replace("Σ", "σ").lower()
    if not small.keys().isdisjoint(used):
        text = "".join([small.get(c, c) for c in text])
    strange = _strange()
    if strange.keys().isdisjoint(set(text)):
        return SPLIT.findall(text)
    known = "".join([strange.get(c, c) for c in text])
    return [text[m.start() : m.end()] for m in SPLIT.finditer(known)]


#: Words kept while a task runs; beyond it the table starts anew.
CACHED_WORDS = 100_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 256
    for b in plain:
        table[b] = chr(b)
    for b in range(256):
        if not table[b]:
            table[b] = chr(extra)
            extra += 1
    return table


class Codec:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        split = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), None)
        if model["type"] != "BPE" or split != PATTERN or spec["decoder"] is not None:
            raise ValueError(f"{path} is not of the supported kind")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        alphabet = byte_alphabet()
        self.first = np.array([vocab.get(c, -1) for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in alphabet], dtype=np.int64)
        if min(self.first.min(), self.last.min()) < 0:
            raise ValueError(f"{path} lacks single bytes")
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    # -- segment trees ------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; NONE where there is no such merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def _merge_all(self, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Merges rows of ``symbols`` (count[i] of them used, a power of two plus one wide); merged-away cells become -1."""
        n, width = symbols.shape
        leaves = width - 1
        rows = np.arange(n)
        column = np.arange(leaves)
        rank = np.full((n, leaves), NONE)
        used = column[None, :] < (count - 1)[:, None]
        rank[used] = self._ranks(symbols[:, :-1][used], symbols[:, 1:][used])
        tree = np.full((n, 2 * leaves), NONE)
        tree[:, leaves:] = np.where(rank == NONE, NONE, rank * leaves + column)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))

        def put(who: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[who, node] = value
            while node[0] > 1:  # all leaves are on one level
                node = node >> 1
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

        def pair(who: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            inside = nxt < count[who]
            r = np.full(len(who), NONE)
            r[inside] = self._ranks(symbols[who[inside], at[inside]], symbols[who[inside], nxt[inside]])
            return np.where(r == NONE, NONE, r * leaves + at)

        who = rows[tree[:, 1] != NONE]
        while len(who):
            root = tree[who, 1]
            at, rank_now = root % leaves, root // leaves
            gone = after[who, at]
            symbols[who, at] = self.merged[rank_now]
            symbols[who, gone] = -1
            nxt = after[who, gone]
            after[who, at] = nxt
            inner = nxt < width
            before[who[inner], nxt[inner]] = at[inner]
            kept = gone < leaves  # the last symbol starts no pair
            if kept.any():
                put(who[kept], gone[kept], np.full(int(kept.sum()), NONE))
            put(who, at, pair(who, at, nxt))
            prev = before[who, at]
            left = prev >= 0
            if left.any():
                put(who[left], prev[left], pair(who[left], prev[left], at[left]))
            who = who[tree[who, 1] != NONE]
        return symbols

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed token ids of each word."""
        out = [b""] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(np.int64))
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // int(w))
            for start in range(0, len(own), step):
                part = own[start : start + step]
                count = size[part]
                symbols = np.full((len(part), int(w) + 1), -1, dtype=np.int64)
                mask = np.arange(int(w) + 1)[None, :] < count[:, None]
                symbols[mask] = self.first[np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)]
                symbols[np.arange(len(part)), count - 1] = self.last[[raw[i][-1] for i in part]]
                symbols = self._merge_all(symbols, count)
                alive = symbols >= 0
                flat, ends = symbols[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
                begin = 0
                for i, end in zip(part.tolist(), ends):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    # -- texts --------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Words of a text in order, special tokens as themselves."""
        if self.special_re is None or "<|" not in text:
            return split_words(text)
        out: list[str] = []
        for k, part in enumerate(self.special_re.split(text)):
            out.extend([part] if k % 2 else split_words(part))
        return out

    def learn(self, words: set[str]) -> None:
        """Adds words to the table of known ones."""
        new = list(words.difference(self.ids))
        if len(self.ids) + len(new) > CACHED_WORDS:
            self.ids.clear()
            self.text.clear()
            new = list(words)
        new = [w for w in new if w not in self.special] if self.special else new
        for w, i in self.special.items():
            self.ids[w], self.text[w] = int(i).to_bytes(4, "little"), w
        for w, ids in zip(new, self.encode_words(new)):
            self.ids[w] = ids
            self.text[w] = " ".join([self.tokens[i] for i in memoryview(ids).cast("I")])

    def encode(self, text: str | None) -> list[int]:
        words = self.words(text or "")
        self.learn(set(words))
        return np.frombuffer(b"".join([self.ids[w] for w in words]), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids is the packed little-endian unsigned 32-bit form, decoded the text of the ids.

    Map only: no shuffle.  A worker holds the table of known words (bounded)
    and one slice of texts.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = pa.schema([("key", rows_type(rows)), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            yield from encode(c, batches)
        finally:  # workers are used again by other stages
            c.ids.clear()
            c.text.clear()

    def encode(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars < 1 << 20):
                    chars += len(texts[stop] or "")
                    stop += 1
                split = [c.words(t) if t else [] for t in texts[start:stop]]
                c.learn(set().union(*split))
                ids = [b"".join([c.ids[w] for w in ws]) for ws in split]
                decoded = [" ".join([c.text[w] for w in ws]) for ws in split]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, stop - start), pa.array([len(b) >> 2 for b in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=schema
                )
                start = stop

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"key {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("key", key)


def rows_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["key"].dataType)

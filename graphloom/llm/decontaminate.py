"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space runs as one blank.
An item of m characters may differ from a passage by up to k edits, a tenth of m
(``ERROR_RATE``, rounded down).  It is split into k + 1 pieces: whatever the k
edits hit, one piece is intact.  The pieces are laid over four quarters (fewer
if k is below three) as evenly as they go; were more edits in each quarter than
it has pieces less one, there would be more than k, so some quarter with p
pieces has at most p - 1 edits and, by the same argument, an intact piece.
Piece hits are found by an Aho-Corasick automaton; around each, first the quarter
within its own budget and then the whole item are verified with Myers'
bit-parallel distance.  Nothing within k edits is missed.

Items are taken in blocks of at most about ``BLOCK_CHARS`` characters, each
block by a pass of its own, so that the automaton in a worker is bounded however
many items there are, and the driver holds one block at a time.  A worker keeps
it for a task's duration only.  Texts are never shuffled.

Defined results: null and empty texts hold nothing; null items and those
without a visible character are never found; an item given twice is reported
under each id; per row and item the passage of least distance, of these the
leftmost, is reported; repeated rows are each reported; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise, tidy

ERROR_RATE = 0.10
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int) -> int:
    return int(ERROR_RATE * m + 1e-9)


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of text, the first end at which it occurs); Myers 1999."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # the first row is free: a match may begin anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Item:
    item_id: int
    text: str

    def __post_init__(self) -> None:
        m = len(self.text)
        self.k = budget(m)
        n = min(4, self.k + 1)
        #: Pieces of each quarter; it may have one edit less.
        self.share = [(q + 1) * (self.k + 1) // n - q * (self.k + 1) // n for q in range(n)]
        # a quarter is as long as its pieces' share, so that pieces are of about one length
        cut = [q * (self.k + 1) // n * m // (self.k + 1) for q in range(n + 1)]
        self.quarters = list(zip(cut, cut[1:]))

    # made when a first hit is verified: most items have none

    @cached_property
    def masks(self) -> dict[str, int]:
        return _masks(self.text)

    @cached_property
    def back(self) -> dict[str, int]:
        return _masks(self.text[::-1])

    @cached_property
    def parts(self) -> list[tuple[dict[str, int], list[tuple[str, int]]]]:
        """Of each quarter: masks, and its letters by how often they occur."""
        return [(_masks(self.text[a:b]), Counter(self.text[a:b]).most_common()) for a, b in self.quarters]

    def pieces(self) -> Iterator[tuple[str, int, int]]:
        """(piece, its start, its quarter)."""
        for q, ((a, b), per) in enumerate(zip(self.quarters, self.share)):
            for j in range(per):
                start, end = a + j * (b - a) // per, a + (j + 1) * (b - a) // per
                yield self.text[start:end], start, q


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [Item(i, t) for i, t in items]
        posted: dict[str, list[tuple[int, int, int]]] = {}
        for x, item in enumerate(self.items):
            for piece, start, quarter in item.pieces():
                posted.setdefault(piece, []).append((x, start, quarter))
        self.automaton = ahocorasick.Automaton()
        for piece, where in posted.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in the whole text, positions in the text as given."""
        low = normal(text) if text else ""
        if not low or not self.items:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for at, (size, where) in self.automaton.iter(low):
            for x, start, q in where:
                item = self.items[x]
                begin = at + 1 - size - start  # where the item would begin
                if done.get((x, q)) == begin:
                    continue  # another piece of the quarter on the same diagonal
                done[x, q] = begin
                a, b = item.quarters[q]
                slack = item.share[q] - 1
                if slack:
                    masks, letters = item.parts[q]
                    near = low[max(0, begin + a - slack) : begin + b + slack]
                    # each character that the quarter has more often than the passage costs an edit
                    lacking = 0
                    for c, n in letters:
                        if (few := n - near.count(c)) > 0:
                            lacking += few
                            if lacking > slack:
                                break
                    if lacking > slack or best_match(masks, b - a, near)[0] > slack:
                        continue
                left = max(0, begin - item.k)
                d, end = best_match(item.masks, len(item.text), low[left : begin + len(item.text) + item.k])
                if d > item.k:
                    continue
                _, back = best_match(item.back, len(item.text), low[left : left + end][::-1])
                found = (d, left + end - back, left + end)
                if x not in best or found < best[x]:
                    best[x] = found
        if not best:
            return []
        place = _places(text)
        return sorted((self.items[x].item_id, place[a], place[b - 1] + 1, d) for x, (d, a, b) in best.items())


def _places(text: str) -> list[int]:
    """For each character of the normal form, its place in the text."""
    low = text.lower()
    origin = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out: list[int] = []
    for m in re.finditer(r"\S+", low):
        if out:
            out.append(origin[m.start() - 1])  # a blank stands for the last of its run
        out.extend(origin[i] for i in range(*m.span()))
    return out


def _scan(docs: DataFrame, items: list[tuple[int, str]], key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most about BLOCK_CHARS
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            where, found = [], []
            for i, t in enumerate(batch.column(1)):
                for hit in matcher.find(t.as_py()):
                    where.append(i)
                    found.append(hit)
            if found:
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *columns], [key, "item_id", "start", "end", "distance"])

    return rows.mapInArrow(tidy(run), f"`{key}` {rows.schema[key].dataType.simpleString()}, item_id bigint, start bigint, end bigint, distance bigint")


def _keep(docs: DataFrame, items: list[tuple[int, str]], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most about BLOCK_CHARS
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, block_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(the items in blocks of at most about ``block_chars`` characters, whether it is the only one)."""
    items = benchmark.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null")
    total = items.agg(F.sum(F.length("t"))).collect()[0][0] or 0
    blocks = int(total // block_chars) + 1
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted({(r["item"], n) for r in own.collect() if (n := normal(r["t"]))}), blocks == 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, start, end, distance): items that occur in the rows' texts within their error budget.

    With several blocks each one's result is written before the next is read.
    """
    parts = []
    for held, only in _blocks(benchmark, item_key, item_text, block_chars):
        part = _scan(docs, held, key, text)
        parts.append(part if only else materialise(part, "leaks"))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, with all their columns, whose texts hold no item; each row is judged by itself, whatever its id.

    With several blocks what each leaves is written before the next is read.
    """
    before = None
    for held, only in _blocks(benchmark, item_key, item_text, block_chars):
        docs = _keep(docs, held, text)
        if not only:
            docs = materialise(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs

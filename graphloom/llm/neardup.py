"""Near duplicates with SetSketch registers.

A document's set is that of its distinct five-word shingles (words are runs
without white space, A-Z in lower case; with fewer words the whole sequence is
one shingle; without words the set is empty and linked with nothing).

1. Sketch.  Register i of a set is the minimum of an exponential variate per
   element, as a truncated exponent: K = clip(floor(1 - log_b(min / TOP)), 0,
   255).  Registers of unions are maxima, so sketches merge.  An element's
   variates are made in ascending order, over a pseudo-random order of the
   registers, until they exceed all of the set's minima.
2. Class.  Documents with equal sets form a class, represented by the smallest
   id; from here on only classes count.
3. Band.  Runs of ``rows`` register values are hashed to buckets.
4. Star.  Each member of a bucket is paired with the member that shares most
   buckets with others (of copies of a template, the template).  Pairs whose
   joint maximum-likelihood estimate is out of reach are dropped, the others
   verified on full sets.  Linear in the bucket, whatever its size.
5. Rest.  Members of a bucket that are still in different components may be
   linked otherwise.  Of two sets as similar as the threshold t, each holds a
   shingle of the other among its n - ceil(t * n) + 1 rarest; so only sets that
   share one of these are compared, by their registers, in blocks of at most
   ``BLOCK``, and only pairs within reach that would join two components are
   verified.  Documents that share a passage but not their rarest shingles
   cost nothing.  No bucket is cut, no pair within reach is lost.
6. Components of the verified links by alternating large and small stars.

Sets are compared as 64-bit hashes of shingles.  With the default bands a pair
exactly at the threshold is missed with a probability of 5e-7 (at 0.85) or 1e-5
(at 0.8), and of far less above it.  Links, components and sketches stay in tables.

Defined results: null and empty texts have n_shingles 0 and are their own
component; rows that share an id are one document, each row is returned; a null
id is linked with nothing, has a null component and is kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import discard, materialise, slices, small_batches, tidy

SHINGLE = 5
REGISTERS = 256
BANDS = 36
BASE, TOP = 1.1, 20.0
#: Estimates are believed up to so many standard errors.
SLACK = 4.5
BLOCK = 1024
#: Size of the bitmap that tells the scan which documents are wanted.
FILTER_BITS = 1 << 24
SLICE = 1 << 19
#: Rows that hold sets of shingles and go to a Python worker at once.
BATCH = 1_000
#: Rounds of stars after which components that still change are an error.
MOST_ROUNDS = 99

U = np.uint64
_B = U(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = U(pow(int(_B), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        one = np.ones(size, dtype=U)
        one[1:] = _B
        inverse = np.ones(size, dtype=U)
        inverse[1:] = _B_INVERSE
        _POWERS[size] = np.cumprod(one), np.cumprod(inverse)
    return _POWERS[size]


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text i's distinct shingles are hashes[offsets[i]:offsets[i + 1]], ascending."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    space = _SPACE[data]
    inside = np.concatenate([[True], space])
    starts = np.flatnonzero(inside[:-1] & ~space)
    ends = np.flatnonzero(~inside[1:-1] & inside[2:]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
    word = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    owner = np.searchsorted(begin, starts, side="right") - 1
    count = np.bincount(owner, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    shingle = np.zeros(len(word), dtype=U)
    for k in range(SHINGLE):
        shingle[: len(word) - k] += word[k:] * U(2 * k + 3) * _B
    whole = np.ones(len(word), dtype=bool)
    for k in range(1, SHINGLE):
        whole[len(word) - k :] = False
    last = first + count
    whole &= np.arange(len(word)) + SHINGLE <= last[owner]
    values, owners = [_mix(shingle[whole])], [owner[whole]]
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        own = word[first[i] : last[i]]
        odd = U(2) * np.arange(len(own), dtype=U) + U(3)
        values.append(_mix((own * odd).sum(dtype=U, keepdims=True) * _B + U(len(own))))
        owners.append(np.array([i]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))])


def registers(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) of uint8; a set without elements has zeros."""
    n = len(offsets) - 1
    least = np.full(n * REGISTERS, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = (value & U(REGISTERS - 1)).astype(np.int64)
    stride = ((value >> U(8)) & U(REGISTERS - 1)).astype(np.int64) | 1
    time, state = np.zeros(len(value)), value
    for j in range(REGISTERS):
        if not len(owner):
            break
        state = _mix(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS - j)
        np.minimum.at(least, owner * REGISTERS + at, time)
        bound = least.reshape(n, REGISTERS).max(1)
        on = time < bound[owner]
        owner, at, stride, time, state = owner[on], at[on], stride[on], time[on], state[on]
        at = (at + stride) & (REGISTERS - 1)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / TOP) / math.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, 255).astype(np.uint8).reshape(n, REGISTERS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _log_b(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, grid: int = 50) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity from the numbers of registers of a
    that exceed those of b, and the reverse, given both sets' sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid + 1)[None, :] * np.minimum(u / v, v / u)
    p, q = np.maximum(_log_b(np.maximum(u - v * j, 0)), 1e-9), np.maximum(_log_b(np.maximum(v - u * j, 0)), 1e-9)
    same = (REGISTERS - more - less)[:, None]
    like = more[:, None] * np.log(p) + less[:, None] * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-9))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def reach(threshold: float) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def within_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Row by row: whether two sets may be as similar as the threshold."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
    out = np.zeros(len(a), dtype=bool)
    if fits.any():
        out[fits] = estimate(na[fits].astype(float), nb[fits].astype(float), more[fits], less[fits]) >= reach(threshold)
    return out


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): six rows below 0.85, seven from there on."""
    return BANDS, 6 if threshold < 0.85 else 7


# -- tables -------------------------------------------------------------------


def sketch_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, cls, sig): set size, 128-bit digest of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1).to_pylist(), SLICE):
                value, offsets = shingle_sets(texts)
                sig = registers(value, offsets)
                n = np.diff(offsets)
                two = np.stack([_mix(value), _mix(value ^ U(0xD6E8FEB86659FD93))], 1)
                padded = np.concatenate([two, np.zeros((1, 2), U)])
                digest = np.add.reduceat(padded, np.minimum(offsets[:-1], len(two)), axis=0, dtype=U)
                digest[n == 0] = 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).slice(first, len(texts)),
                        "n": pa.array(n, pa.int64()),
                        "cls": pa.array([d.tobytes() for d in digest], pa.binary()),
                        "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
                    }
                )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text)).mapInArrow(tidy(run), "id bigint, n bigint, cls binary, sig binary")


def _pairs_in_reach(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs whose registers may mean the threshold."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                sigs = [np.frombuffer(b"".join(f[c]), dtype=np.uint8).reshape(-1, REGISTERS) for c in ("sa", "sb")]
                yield f.loc[within_reach(*sigs, f["na"].to_numpy(), f["nb"].to_numpy(), threshold), ["a", "b"]]

    return both.mapInPandas(tidy(run), "a bigint, b bigint")


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Hashes of the ids as a bitmap of a fixed size; at most one number a word reaches the driver."""
    bits = ids.select(_slot("id").alias("slot")).groupBy(F.floor(F.col("slot") / 32).alias("word")).agg(F.bit_or(F.expr("1L << cast(slot % 32 as int)")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    bitmap[[r["word"] for r in bits]] = [r["bits"] for r in bits]
    return bitmap


def _on(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32) & 1) == 1


def drop_copies(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is kept; of the others only ids that the bitmap of dropped ones may hold are joined."""
    dropped = groups.where("not kept").select(F.col(key).alias("id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(dropped))

    @F.pandas_udf("boolean")
    def maybe(slot: pd.Series) -> pd.Series:
        return pd.Series(_on(shared.value, slot.to_numpy()))

    rows = docs.withColumn("__id", F.col(key).cast("bigint"))
    rows = rows.withColumn("__maybe", maybe(_slot("__id")))
    joined = rows.where("__maybe").join(dropped.withColumnRenamed("id", "__id"), "__id", "left_anti")
    return rows.where("not __maybe").unionByName(joined.select(rows.columns)).drop("__id", "__maybe")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(id, shingles) of the wanted ids, written to the shared folder.

    A bitmap of the wanted ids' hashes, of a fixed size, lets the scan drop most
    of the other rows, before the join that is exact; were the bitmap full, it
    would only drop fewer.
    """
    wanted = wanted.select("id").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(_on(shared.value, slot)))
            for first, own in slices(batch.column(1).to_pylist(), SLICE):
                value, offsets = shingle_sets(own)
                cut = offsets.tolist()
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(first, len(own)), "shingles": pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    own = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    table = own.select("id", "text", _slot("id").alias("slot")).mapInArrow(tidy(sets), "id bigint, shingles binary").join(wanted, "id", "left_semi")
    # rows that share an id are one document: any of them decides, the largest for all runs alike
    return materialise(table.groupBy("id").agg(F.max("shingles").alias("shingles")), name)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of those pairs whose full sets are as similar as the threshold, exactly in integers."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    up, down = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(down * common >= up * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(compare), "a bigint, b bigint")


def _rare_members(sets: DataFrame, told: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, id, component): each set under its rarest shingles, as many as any set similar enough must share one of.

    Shingles of a single set come first in the order of rarity and are never
    shared; they are only counted.
    """
    up, down = threshold

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                own = batch.slice(i, 256)
                held = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in own.column(1)]
                size = np.array([len(x) for x in held], dtype=np.int64)
                ids = np.repeat(own.column(0).to_numpy(), size)
                yield pa.RecordBatch.from_pydict({"id": ids, "n": np.repeat(size, size), "key": np.concatenate(held)})

    tokens = sets.select("id", "shingles").mapInArrow(tidy(explode), "id bigint, n bigint, key bigint")
    shared = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    rows = tokens.join(shared, "key")
    w = Window.partitionBy("id")
    # n - ceil(t * n) + 1 places, of which the shingles of this set alone take the first
    places = F.col("n") - F.expr(f"({up} * n + {down} - 1) div {down}") + 1
    rows = rows.withColumn("lone", F.col("n") - F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("df", "key")))
    rows = rows.where(F.col("place") + F.col("lone") <= places).select("key", "id")
    return rows.join(told, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, component) of every linked id, component being the smallest id reachable.

    Alternating large and small stars; each round is written to the shared
    folder, and a digest of its rows tells when nothing changes any more.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = both.join(least, "a")
        if large:
            out = told.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    edges = materialise(links.select("a", "b").distinct(), f"{name}-0")
    digest = None
    for round_ in range(1, MOST_ROUNDS + 1):
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).collect()[0]
        if tuple(now) == digest or not now[0]:
            break
        digest, before = tuple(now), edges
        edges = materialise(star(star(edges, True), False), f"{name}-{round_}")
        discard(before)
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    tops = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops).groupBy("id").agg(F.min("component").alias("component"))


def _rest(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) within reach among bucket members of different components; members: key, id, component."""
    mixed = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "size")
    rows = members.join(mixed, "key").join(classes.select("id", "n", "sig"), "id")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sig")
    # by a stated number: small rows that take long to compare aren't to be coalesced by their bytes
    tasks = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def pairs_of(g: pd.DataFrame) -> pd.DataFrame | None:
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(-1, REGISTERS)
        ids, comp, n, own = (g[c].to_numpy() for c in ("id", "component", "n", "own"))
        cross = g["i"].iat[0] != g["j"].iat[0]
        found = []
        for x in range(len(g) - 1):
            y = np.arange(x + 1, len(g))
            y = y[(comp[y] != comp[x]) & (~cross | (own[y] != own[x]))]
            if len(y):
                ok = within_reach(np.broadcast_to(sig[x], (len(y), REGISTERS)), sig[y], np.full(len(y), n[x]), n[y], threshold)
                found.append(pd.DataFrame({"a": np.minimum(ids[x], ids[y[ok]]), "b": np.maximum(ids[x], ids[y[ok]])}))
        return pd.concat(found) if found else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None
        for f in frames:
            f = f if carry is None else pd.concat([carry, f], ignore_index=True)
            if not len(f):
                continue
            new = (f[["key", "i", "j"]] != f[["key", "i", "j"]].shift()).any(axis=1).to_numpy()
            cut = [*np.flatnonzero(new).tolist(), len(f)]
            for a, b in zip(cut[:-2], cut[1:-1]):
                if (out := pairs_of(f.iloc[a:b])) is not None:
                    yield out
            carry = f.iloc[cut[-2] :]
        if carry is not None and (out := pairs_of(carry)) is not None:
            yield out

    return rows.mapInPandas(tidy(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; threshold is a fraction of integers."""
    with small_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, threshold, key, text)


def _near_duplicates(docs: DataFrame, threshold: tuple[int, int], key: str, text: str) -> DataFrame:
    share = threshold[0] / threshold[1]
    bands, rows = banding(share)
    sketches = materialise(sketch_table(docs, key, text), "neardup-sketches")
    classes = sketches.where("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # rows that share an id are one document: their classes meet in it
    classes = materialise(classes, "neardup-classes")
    one = classes.groupBy("id").agg(F.max(F.struct("cls", "n", "sig")).alias("x")).select("id", "x.n", "x.sig")
    twins = sketches.where("n > 0 and id is not null").join(classes.select("cls", F.col("id").alias("top")), "cls").where("id <> top").groupBy("id").agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
    twins = twins.join(classes.select("id"), "id", "left_semi").select(F.col("lo").alias("a"), F.col("id").alias("b"))

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * rows + 1, F.lit(rows)))))
    members = one.select(band.alias("key"), "id")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(members.join(sizes, "key"), "neardup-members")

    known = members.groupBy("id").agg(F.sum("size").alias("known"))
    ranked = members.join(known, "id").select("key", "id", "known")
    tops = ranked.groupBy("key").agg(F.max(F.struct("known", -F.col("id"))).alias("m")).select("key", (-F.col("m.col2")).alias("top"))
    star = members.join(tops, "key").where("id <> top").select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")).distinct()
    star = materialise(_pairs_in_reach(star, one, share), "neardup-pairs")
    ends = star.select(F.explode(F.array("a", "b")).alias("id"))
    held = _sets(docs, ends, key, text, "neardup-sets")
    first = materialise(_verified(star, held, threshold), "neardup-links")
    discard(star, held)
    told = materialise(components(first, "neardup-cc"), "neardup-first")

    placed = members.join(told, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    sets = _sets(docs, placed.join(mixed, "key", "left_semi"), key, text, "neardup-rest-sets")
    rest = materialise(_rest(_rare_members(sets, told, threshold), one, share), "neardup-rest")
    second = _verified(rest, sets, threshold)
    links = told.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).union(second).union(twins)
    final = materialise(components(links, "neardup-cc2"), "neardup-components")
    discard(members, first, told, sets, rest)

    tops = classes.join(final, "id", "left").select("cls", F.coalesce("component", "id").alias("top"))
    out = sketches.join(tops, "cls", "left").select(F.col("id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("top")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

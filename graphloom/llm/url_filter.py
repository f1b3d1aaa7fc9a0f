"""URL filters (native): pattern rules indexed by their rarest literal token.

A rule is matched against ``host || path`` of a URL (host in lower case).
Every rule has literal tokens, the complete runs of ``[a-z0-9]`` which any URL
that it fits must contain.  The rule is posted under the one of them which is
rarest among the URLs at hand.  A URL's tokens fetch the rules posted under
them, and only those candidate rules run their regular expressions.

Everything is DataFrame operations: higher-order functions over a URL's tokens
look up buckets of the index, a constant of the plan.

Defined results: a null URL or one without ``://`` has empty host and path,
fits no rule and gets the default verdict; repeated rows are judged one by
one; among rules that fit, precedence is: host rules before pattern rules,
then the longest, then the last in string order.  Other columns of the
input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_FIELDS = "host_rule:int,long:int,rule:string,verdict:string,token:string,regex:string"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``kind`` host: ``text`` is host/path, fits subdomains and longer paths.
    ``kind`` pattern: ``text`` may hold ``*`` (anything) and ``^`` (a separator
    or the end); a leading ``||`` anchors it at a label of the host."""

    text: str
    verdict: str
    kind: str = "host"

    def regex(self) -> str:
        if self.kind == "host":
            host, slash, path = self.text.partition("/")
            return r"(?s)^(?:[^/]*\.)?" + _quote(host) + _quote(slash + path)
        body, anchored = self.text, self.text.startswith("||")
        out = [r"(?s)^(?:[^/]*\.)?" if anchored else "(?s)"]
        for ch in body[2:] if anchored else body:
            out.append(".*" if ch == "*" else r"(?:[^a-zA-Z0-9_%.-]|$)" if ch == "^" else _quote(ch))
        return "".join(out)

    def tokens(self) -> list[str]:
        """Tokens which are complete in any URL that fits: neither end may go on."""
        anchored = self.kind == "host" or self.text.startswith("||")
        body = self.text.removeprefix("||") if self.kind == "pattern" else self.text
        found = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            before, after = body[: m.start()][-1:], body[m.end() :][:1]
            left = anchored if not before else before != "*"
            right = bool(after) and after != "*"
            if self.kind == "host" and not after and "/" not in body:
                right = False  # the host's last label is followed by the end or by a port
            if left and right:
                found.append(m.group().lower())
        return sorted(set(found))


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)


HOST_RULES = (
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
)
PATTERN_RULES = (
    Rule("||casino-win.", "block", "pattern"),
    Rule("||cheap-pills.", "block", "pattern"),
    Rule("||free-bets.", "block", "pattern"),
    Rule("||ads.", "block", "pattern"),
    Rule("/ads/", "block", "pattern"),
    Rule("/tracking^", "block", "pattern"),
    Rule("-casino.", "block", "pattern"),
    Rule("||poker-*.example.", "block", "pattern"),
    Rule("/wp-login.php^", "block", "pattern"),
    Rule("||doubleclick.", "block", "pattern"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL_PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))


def rule_index(targets: DataFrame, rules: tuple[Rule, ...]) -> list[list[dict]]:
    """Buckets of rules by crc32 of the token they are posted under, the rarest of each among ``targets.target``.

    The counts that reach the driver are those of the rules' own tokens only.
    """
    rules = tuple(dict.fromkeys(rules))
    if bare := [r.text for r in rules if not r.tokens()]:
        raise ValueError(f"rules without a literal token can't be indexed: {bare}")
    words = sorted({t for r in rules for t in r.tokens()})
    known = F.from_json(F.lit(json.dumps(words)), "array<string>")
    seen = targets.select(F.explode(F.array_intersect(url_tokens(F.col("target")), known)).alias("token"))
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()} if words else {}
    buckets: list[list[dict]] = [[] for _ in range(1 << max(1, len(rules)).bit_length())]
    for r in rules:
        token = min(r.tokens(), key=lambda t: (counts.get(t, 0), t))
        row = {"host_rule": int(r.kind == "host"), "long": len(r.text), "rule": r.text, "verdict": r.verdict, "token": token, "regex": r.regex()}
        buckets[zlib.crc32(token.encode()) % len(buckets)].append(row)
    return buckets


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, matched, verdict, host_rule) of every row; matched is null where no rule fits.

    Rows are never shuffled.  The one shuffle is of the counts of the rules'
    tokens, pre-aggregated.  The index is a constant of the plan, as large as
    the rules given; a token's bucket is found by its checksum.
    """
    host, path = url_parts(F.col(url))
    base = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    buckets = rule_index(base, rules)
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{RULE_FIELDS}>>>")
    fetched = F.flatten(
        F.transform(url_tokens(F.col("target")), lambda t: F.filter(F.get(index, (F.crc32(t) % len(buckets)).cast("int")), lambda r: r["token"] == t))
    )
    fits = F.filter(fetched, lambda r: F.regexp_like(F.col("target"), r["regex"]))
    out = base.select(key, "host", "path", F.array_max(fits).alias("best"))
    return out.select(
        key,
        "host",
        "path",
        F.col("best.rule").alias("matched"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.coalesce("best.host_rule", F.lit(0)).alias("host_rule"),
    )

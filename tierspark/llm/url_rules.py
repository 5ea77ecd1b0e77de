"""URL filters: host and path rules, and pattern rules found by their rarest literal token.

A *place* rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest
that fits decides. Where none fits, *pattern* rules do. Running every pattern on every URL would cost as
much as there are patterns, so each pattern is filed under the one of its literal tokens that is rarest in
the URLs themselves. The tokens of a URL fetch the few patterns filed under them, and only those run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.llm.common import pick

ALLOW, BLOCK = "allow", "block"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile("[a-z0-9]+")
IN_HOST = r"^[^:/?#]*://(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class PlaceRule:
    """``rule`` is a host followed by the beginning of a path, such as ``example.org/en/``."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


@dataclass(frozen=True)
class PatternRule:
    """A lower-case text to find in a URL: ``*`` is any run of characters, ``^`` an edge or no letter or digit.

    One that begins with ``||`` fits only from the start of a part of the host on.
    """

    pattern: str
    verdict: str = BLOCK
    expression: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        parts = {"*": ".*", "^": "(?:^|$|[^a-z0-9])"}
        text = "".join(parts.get(c) or re.escape(c) for c in self.pattern.removeprefix("||"))
        object.__setattr__(self, "expression", re.compile(IN_HOST * self.in_host + text, re.DOTALL))

    @property
    def in_host(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL with this pattern has as a whole: both ends are fixed by the pattern."""
        p = self.pattern.removeprefix("||")
        return [
            m[0]
            for m in TOKEN.finditer(p)
            if (m.start() > 0 or self.in_host) and m.end() < len(p) and p[m.start() - 1 : m.start()] != "*" and p[m.end()] != "*"
        ]


def address(url: str | None) -> tuple[str, str]:
    """``(host, path)``: A-Z of the host in lower case; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


class PlaceIndex:
    """Place rules by host, the longest first."""

    def __init__(self, rules: Sequence[PlaceRule]):
        self._by_host: dict[str, list[PlaceRule]] = defaultdict(list)
        for rule in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
            self._by_host[rule.host].append(rule)

    def find(self, host: str, path: str) -> PlaceRule | None:
        best = None
        while host:
            for rule in self._by_host.get(host, ()):
                if path.startswith(rule.path) and (best is None or len(rule.rule) > len(best.rule)):
                    best = rule
            host = host.partition(".")[2]
        return best


class PatternIndex:
    """Pattern rules by their rarest token; those without a token are tried on every URL."""

    def __init__(self, rules: Sequence[PatternRule], counts: dict[str, int]):
        self._by_token: dict[str, list[tuple[int, PatternRule]]] = defaultdict(list)
        self._always: list[tuple[int, PatternRule]] = []
        for order, rule in enumerate(rules):
            tokens = sorted(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            (self._by_token[tokens[0]] if tokens else self._always).append((order, rule))

    def candidates(self, url: str) -> list[PatternRule]:
        found = list(self._always)
        for token in set(TOKEN.findall(url)):
            found += self._by_token.get(token, ())
        return [rule for _, rule in sorted(found, key=lambda c: c[0])]

    def find(self, url: str | None) -> PatternRule | None:
        """The first rule, in the order given, whose pattern occurs in the URL."""
        text = (url or "").translate(LOWER)
        return next((rule for rule in self.candidates(text) if rule.expression.search(text)), None)


def token_counts(urls: DataFrame, rules: Sequence[PatternRule], url: str = "url") -> dict[str, int]:
    """How many times each token of the rules occurs in all URLs; at most one number per token of the rules."""
    tokens = sorted({token for rule in rules for token in rule.tokens})
    if not tokens:
        return {}
    rows = pick(urls, _url=url)
    found = rows.select(F.explode(F.split(F.lower("_url"), "[^a-z0-9]+")).alias("token"))
    counted = found.where(F.col("token").isin(tokens)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {row["token"]: row["n"] for row in counted.collect()}


def judge(
    urls: DataFrame,
    places: Sequence[PlaceRule],
    patterns: Sequence[PatternRule],
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``(key, host, path, rule, verdict, pattern)`` per row.

    ``rule`` is the place rule that decided, else NULL; then ``pattern`` is the pattern that did, if any, and
    a URL that nothing fits is allowed. A NULL URL, or one without ``://``, has an empty host and path. Rows
    that repeat are judged alike; no row is moved.
    """
    counts = token_counts(urls, patterns, url)
    rows = pick(urls, **{key: key, "_url": url})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place, by_pattern = PlaceIndex(places), PatternIndex(patterns, counts)
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                host, path = address(value)
                place = by_place.find(host, path)
                pattern = None if place else by_pattern.find(value)
                verdict = place.verdict if place else pattern.verdict if pattern else ALLOW
                out.append((host, path, place and place.rule, verdict, pattern and pattern.pattern))
            columns = [list(c) for c in zip(*out)] or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.string()) for c in columns]],
                [key, "host", "path", "rule", "verdict", "pattern"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, pattern string")

"""URL filters: pattern rules indexed by their rarest literal token.

Every rule knows literal tokens that any URL it fits must hold. One pass counts these tokens in all
URLs; each rule is filed under its rarest one. A URL's tokens then fetch the few candidate rules, and
only those run their regular expressions. Host rules: the longest that fits wins, a block over an allow
of equal length. Where none fits, pattern rules give the method's verdict, in their order, else it is allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A null URL or one without ``://``: both empty, verdict block, as there is nothing
to fetch. Repeated rows are judged alike, whole URLs are read, an empty table gives no rows. Columns named host, path,
rule or verdict are replaced, others pass through. Rules are a parameter, or a table that ``rules_from`` reads, of at
most MAX_RULES; they travel with the code of the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """verdict for the host and all subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """Of the whole host, and of the path's beginning."""
        return rf"(?s)(?:.*\.)?{re.escape(self.host)}\Z", re.escape(self.path)

    @property
    def tokens(self) -> list[str]:
        # The path's last token may go on in the URL, so only those that the rule itself ends count.
        return _TOKEN.findall(self.host.lower()) + [m[0] for m in _TOKEN.finditer(self.path.translate(_LOWER)) if m.end() < len(self.path)]


@dataclass(frozen=True)
class Pattern:
    """verdict where one regular expression is found in the host and another in the path; every token must be in such a URL. Without tokens it is tried on every URL."""

    verdict: str
    host: str = ""
    path: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + " " + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        return self.host, self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: The method's own patterns: hosts named for spam, gambling or adult matter, and paths that lead to it.
PATTERNS = (
    *(Pattern("block", host=rf"(?:\A|[.-]){word}(?:[.-]|\Z)", tokens=(word,)) for word in ("spam", "casino", "porn", "xxx", "viagra", "malware")),
    *(Pattern("block", path=rf"/{word}/", tokens=(word,)) for word in ("casino", "porn", "xxx")),
)


def rules_from(rules: DataFrame) -> tuple[tuple[Rule, ...], tuple[Pattern, ...]]:
    """(rules, patterns) of a table (kind, verdict, host, path, tokens): kind ``prefix`` or ``pattern``, tokens parted by spaces.

    Null host, path and tokens are empty, but a prefix rule's path is then ``/``. Other kinds or verdicts, a prefix
    rule without a host and more than MAX_RULES rows raise ValueError. Repeated rows count once, in the order of their columns.
    """
    rows = rules.select("kind", "verdict", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "tokens"))).distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if any(r.kind not in ("prefix", "pattern") or r.verdict not in ("allow", "block") or (r.kind == "prefix" and not r.host) for r in rows):
        raise ValueError("kind is prefix or pattern, verdict allow or block, and a prefix rule has a host")
    rows = sorted(rows)
    return tuple(Rule(r.verdict, r.host.translate(_LOWER), r.path or "/") for r in rows if r.kind == "prefix"), tuple(Pattern(r.verdict, r.host, r.path, tuple(r.tokens.split())) for r in rows if r.kind == "pattern")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return rest[:end].translate(_LOWER), re.split(r"[?#]", rest[end:], maxsplit=1)[0]


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path.translate(_LOWER)))


def token_counts(pages: DataFrame, wanted: set[str], url: str = "url") -> dict[str, int]:
    """URLs that hold each wanted token, over all rows; the result is bounded by the rules."""

    def count(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                total.update(_tokens(*split_url(u)) & wanted)
        yield pa.RecordBatch.from_pydict({"token": list(total), "n": pa.array(list(total.values()), pa.int64())}, pa.schema([("token", pa.string()), ("n", pa.int64())]))

    found = pages.select(F.col(url).cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in found.collect()}


class RuleIndex:
    """Rules by their rarest token; a regular expression is compiled when its rule is first a candidate."""

    def __init__(self, rules, counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules, self.compiled = list(rules), {}
        for i, r in enumerate(self.rules):
            (self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []) if r.tokens else self.always).append(i)

    def candidates(self, host: str, path: str) -> list[int]:
        """Numbers of the rules whose regular expressions are to run, in the rules' order."""
        return sorted([*self.always, *(i for t in _tokens(host, path) for i in self.by_token.get(t, ()))])

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        if not host:
            return host, path, None, "block"
        best, verdict = None, None
        for i in self.candidates(host, path):
            r = self.rules[i]
            of_host, of_path = self.compiled.get(i) or self.compiled.setdefault(i, tuple(map(re.compile, r.patterns)))
            if isinstance(r, Rule):
                if of_host.match(host) and of_path.match(path) and (best is None or (len(r.name), r.verdict == "block") > (len(best.name), best.verdict == "block")):
                    best = r
            elif verdict is None and of_host.search(host) and of_path.search(path):
                verdict = r.verdict
        return host, path, best.name if best else None, best.verdict if best else verdict or "allow"


def filter_urls(pages: DataFrame, rules=RULES, patterns=PATTERNS, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced."""
    everything = (*rules, *patterns)
    if len(everything) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    counts = token_counts(pages, {t for r in everything for t in r.tokens}, url)
    fields = [f for f in pages.schema.fields if f.name not in ("host", "path", "rule", "verdict")]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    at = [f.name for f in fields].index(url)

    def judge(batches):
        index = RuleIndex(everything, counts)
        for b in batches:
            found = [index.judge(u) for u in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.string()) for i in range(4))], names=schema.names)

    return pages.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(judge, schema)

"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` together with the literal
tokens any match must hold. Each rule is filed under the token that the fewest
rules hold. A URL is cut into tokens; each token fetches the rules filed under
it, and only those run their expressions. The index is a constant array of
buckets inside the expression, so no row moves: the filter is one map-side
projection of built-in functions.

Defined results: a null URL, or one without ``://``, has empty host and path
and no rule. Of fitting host/path rules the longest wins; rules of equal length
are taken in alphabetical order. URLs that no host/path rule fits take the
lexical rules' verdict, else ``allow``. Repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one constant index holds; longer lists are refused (split them and combine the verdicts).
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    lexical: bool = False

    @staticmethod
    def of(verdict: str, name: str) -> Rule:
        """A host/path rule, written ``host/path``; it fits the host and its subdomains."""
        host, slash, rest = name.partition("/")
        path = slash + rest
        whole = path if re.search(r"[^a-z0-9]$", path.lower()) else path[: len(path) - len(re.search(r"[a-z0-9]*$", path.lower())[0])]
        return Rule(name, verdict, rf"(?s)^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", _tokens(f"{host}/{whole}"))

    @staticmethod
    def word(verdict: str, word: str) -> Rule:
        """A lexical rule: the word stands alone between delimiters of the host."""
        return Rule(f"~{word}", verdict, rf"(?s)^[^/]*?(?<![a-z0-9]){_quoted(word)}(?![a-z0-9])[^/]*(/|$)", _tokens(word), True)


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


def _tokens(s: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(r"[a-z0-9]+", s.lower()))))


# The rules of the query's contract.
RULES = (
    Rule.of("allow", "com/"),
    Rule.of("block", "example.com/en/"),
    Rule.of("allow", "www.example.com/en/"),
    Rule.of("block", "net/es/"),
    Rule.of("block", "net/fr/"),
)
#: Words that mark a host as spam where no host/path rule fits.
SPAM_WORDS = ("bets", "betting", "casino", "jackpot", "pills", "poker", "porn", "viagra", "xxx")
LEXICAL = tuple(Rule.word("block", w) for w in SPAM_WORDS)


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


class RuleIndex:
    """Buckets of rules by their rarest token."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        if len(self.rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        held = Counter(t for r in self.rules for t in r.tokens)
        size = 1
        while size < 2 * len(self.rules):
            size *= 2
        self.size = size
        buckets: list[list[dict]] = [[] for _ in range(size)]
        for r in self.rules:
            if not r.tokens:
                raise ValueError(f"rule {r.name!r} holds no literal token")
            token = min(r.tokens, key=lambda t: (held[t], t))
            buckets[zlib.crc32(token.encode()) % size].append({"token": token, "rule": r.name, "verdict": r.verdict, "pattern": r.pattern, "lexical": r.lexical, "length": len(r.name)})
        self.constant = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,rule:string,verdict:string,pattern:string,lexical:boolean,length:int>>>")

    def fitting(self, host: Column, path: Column) -> Column:
        """All rules that fit, as an array of structs."""
        target = F.concat(host, path)
        words = F.array_distinct(F.split(F.translate(target, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+"))
        fetched = F.flatten(F.transform(words, lambda w: F.filter(F.get(self.constant, F.pmod(F.crc32(w.cast("binary")), F.lit(self.size)).cast("int")), lambda r: r["token"] == w)))
        return F.filter(fetched, lambda r: F.regexp_like(target, r["pattern"]))


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES + LEXICAL) -> DataFrame:
    """page_id, host, path, the winning host/path rule and the verdict of every page."""
    index = RuleIndex(rules)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = split.withColumn("fit", index.fitting(F.col("host"), F.col("path")))
    best = F.array_min(F.transform(F.filter("fit", lambda r: ~r["lexical"]), lambda r: F.struct((-r["length"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    word = F.array_min(F.transform(F.filter("fit", lambda r: r["lexical"]), lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return fit.withColumn("best", best).withColumn("word", word).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "word.verdict", F.lit("allow")).alias("verdict"))


ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT s.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM s JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, m.rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(s.host, '(^|[^a-z0-9])({"|".join(SPAM_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (page_id)
"""

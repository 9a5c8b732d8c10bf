"""URL verdicts from pattern rules that are found by their rarest literal token.

A rule is a text with two wildcards: ``*`` stands for any characters, ``^`` for the end or one character that is neither letter nor digit. A run of letters
and digits that the rule bounds on both sides by something else must occur in a matching url as a whole token. Each rule is
listed under that one of its tokens which the urls hold least often; the tokens of a url fetch the rules listed under
them, and only those are tried as regular expressions. A rule without such a token is listed under the empty token, which
every url has. Distinct urls are judged once. All of it is joins, grouping and built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.store import lower_ascii, written

#: Rules of this rank come before those of lower ranks, however long they are.
SITE_RANK, PATTERN_RANK = 1, 0
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """One rule: what it says, the text it is known by, and the expression that a url's key must match from its start."""

    action: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def _bounded_tokens(text: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens of a literal text, without those that could go on beyond an open end."""
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(TOKEN, text.lower())]
    return [t for a, b, t in found if not (open_left and a == 0) and not (open_right and b == len(text))]


def site_rule(action: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and the start of the path; host in lower case, path as it stands."""
    tokens = _bounded_tokens(host + path, False, True)
    return Rule(action, host + path, r"(?:[^/]*[.])?" + re.escape(host) + re.escape(path), tuple(tokens), SITE_RANK)


def pattern_rule(action: str, pattern: str) -> Rule:
    """A pattern anywhere in a url from the ``//`` on; letters A-Z match in either case."""
    out, tokens = [], []
    parts = re.split(r"([*^])", pattern.lower())
    for i, part in enumerate(parts):
        if part in ("*", "^"):
            out.append(".*" if part == "*" else "(?:[^a-z0-9]|$)")
        elif part:
            before = "*" if i == 0 else parts[i - 1]
            after = "*" if i == len(parts) - 1 else parts[i + 1]
            tokens += _bounded_tokens(part, before == "*", after == "*")
            out.append(re.escape(part))
    return Rule(action, pattern, ".*" + "".join(out), tuple(dict.fromkeys(tokens)), PATTERN_RANK)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*[^?#]*((?s:.*))", 1), F.lit(""))


def _key(rank: Column) -> Column:
    """What a rule is matched against: host and path for a site rule, all from ``//`` on in lower case for a pattern."""
    return F.when(rank == SITE_RANK, F.concat("host", "path")).otherwise(lower_ascii(F.concat(F.lit("//"), "host", "path", "rest")))


def listed(spark: SparkSession, rules: Sequence[Rule], tokens: DataFrame) -> DataFrame:
    """(token, rule columns): each rule under its rarest token; ``tokens`` has one row per url and token."""
    schema = "number int, action string, rule string, regex string, rank int, token string"
    rows = [(i, r.action, r.name, r.regex, r.rank, t) for i, r in enumerate(rules) for t in (r.tokens or ("",))]
    spelt = spark.createDataFrame(rows, schema)
    counts = tokens.join(spelt.select("token").distinct(), "token").groupBy("token").count()
    best = F.min_by(F.struct("action", "rule", "regex", "rank", "token"), F.struct(F.coalesce("count", F.lit(0)), F.length("token") * -1, "token"))
    return spelt.join(counts, "token", "left").groupBy("number").agg(best.alias("best")).select("number", "best.*")


def matches(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(url, rule columns) for every rule that a url matches; ``urls`` has distinct values of ``url``."""
    spark = urls.sparkSession
    parts = urls.where("url is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _rest_of(F.col("url")).alias("rest"))
    key = lower_ascii(F.concat("host", "path", "rest"))
    found = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(key, F.lit(f"({TOKEN})"), 1)))
    tokens = parts.where("host <> '' or path <> ''").select("*", F.explode(found).alias("token"))
    index = written(listed(spark, rules, tokens.select("token")), "rules")
    tried = tokens.join(index, "token").withColumn("key", _key(F.col("rank")))
    return tried.where(F.expr("regexp_like(key, concat('^(?s:', regex, ')'))"))


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``pattern``.

    Site rules come first and the longest wins (of equally long ones the least name); ``rule`` names it, else it is null.
    Where none fits the longest pattern decides, named in ``pattern``, and ``default`` where no pattern matches. A url that is
    null, empty or without ``://`` has an empty host and path, matches nothing and gets ``default``. Every row gives a row,
    repeated ones too; columns of those five names are replaced.
    """
    rows = pages.drop("host", "path", "rule", "verdict", "pattern")
    urls = rows.select(F.col(url).alias("url")).distinct()
    order = F.struct("rank", F.length("rule"), F.translate("action", "ab", "ba"))
    chosen = F.max_by(F.struct("rule", "action", "rank"), F.struct(order.alias("o"), F.col("number") * -1)).alias("chosen")
    best = written(matches(urls, rules).groupBy("url").agg(chosen).select("url", "chosen.*"), "verdicts")
    best = best.select(F.col("url").alias("_url"), F.col("rule").alias("_rule"), "action", "rank")
    site = F.col("rank") == SITE_RANK
    return rows.join(best, rows[url] == best["_url"], "left").select(
        *(rows[c] for c in rows.columns),
        host_of(rows[url]).alias("host"),
        path_of(rows[url]).alias("path"),
        F.when(site, F.col("_rule")).alias("rule"),
        F.coalesce("action", F.lit(default)).alias("verdict"),
        F.when(~site, F.col("_rule")).alias("pattern"),
    )

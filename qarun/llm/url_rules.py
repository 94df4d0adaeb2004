"""URL filters: pattern rules found by their rarest literal token."""

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import ascii_lower


class Rule(NamedTuple):
    """``pattern`` runs on host and path; ``tokens`` are words that any match must hold."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def _tokens(literal: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[^a-z0-9]+", literal.lower()) if t)


def site_rule(verdict: str, site: str) -> Rule:
    """A host with all its subdomains and a start of the path, like ``example.net/en/``.

    A path is kept in letter case; its tokens are those before its last separator, as
    the path of a URL may go on in the middle of a word.
    """
    host, slash, path = site.partition("/")
    path = slash + path
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    whole = re.sub(r"[A-Za-z0-9]+\Z", "", path)
    return Rule(site, verdict, pattern, _tokens(host + whole), site=True)


def word_rule(verdict: str, words: str) -> Rule:
    """Words next to each other as a whole, like ``casino-win``, in host or path."""
    tokens = _tokens(words)
    inner = "[^a-z0-9]+".join(tokens)
    return Rule(words, verdict, rf"(?i)(?:^|[^a-z0-9]){inner}(?:[^a-z0-9]|\z)", tokens)


# The sites that are blocked or allowed.
SITES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)

# Our own choice: words of betting, pill and link-farm sites.
WORDS = tuple(
    word_rule("block", words)
    for words in (
        "casino",
        "poker-online",
        "free-bets",
        "sports-betting",
        "cheap-pills",
        "buy-pills",
        "spam-farm",
        "link-farm",
        "payday-loans",
        "xxx",
    )
)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = SITES + WORDS,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in
    lower case; the path goes on from there to ``?``, ``#`` or end. Of the site rules
    that fit, the longest decides and is named in ``rule``. Where none fits, ``rule`` is null and
    the page is blocked if any other rule with that verdict matches, else allowed.

    A null URL, or one without ``://``, has an empty host and path and is allowed. Rows may
    repeat; each gets its verdict. Null ids are ids like others. An empty table gives no
    rows; other columns are not read. A rule needs a literal token, or it raises.

    Each rule is filed under the one of its tokens that the fewest pages hold; the tokens of
    a URL fetch the rules filed under them, and only those run their pattern. The rules are
    a list in the program, so the index is as small as that list.
    """
    spark = pages.sparkSession
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule without a literal token: {rule.rule}")

    after = F.when(
        F.contains(F.col("url"), F.lit("://")), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    ).otherwise(F.lit(""))
    parts = (
        pages.select(F.col(id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
        .select("page_id", after.alias("after"))
        .select(
            "page_id",
            ascii_lower(F.regexp_extract("after", r"(?s)^([^/?#]*)", 1)).alias("host"),
            F.regexp_extract("after", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))
    named = parts.select("page_id", "host", "path", tokens.alias("tokens"))

    # How many pages hold each token of a rule: one row per token of the rule list.
    literals = sorted({token for rule in rules for token in rule.tokens})
    seen = named.select(F.explode("tokens").alias("token")).filter(F.col("token").isin(literals))
    found = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {row.token: row.n for row in found}

    filed = spark.createDataFrame(
        [
            (min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), *rule[:3], rule.site)
            for rule in rules
        ],
        "token string, rule string, rule_verdict string, pattern string, site boolean",
    )
    hits = (
        named.select("page_id", "host", "path", F.explode("tokens").alias("token"))
        .join(F.broadcast(filed), "token")
        .filter(F.regexp_like(target, F.col("pattern")))
    )
    longest = F.max_by(
        F.struct("rule", "rule_verdict"),
        F.when(F.col("site"), F.struct(F.char_length("rule"), F.col("rule"))),
    )
    blocks = ~F.col("site") & (F.col("rule_verdict") == "block")
    blocked = F.coalesce(F.bool_or(blocks), F.lit(False))
    key = ["page_id", "host", "path"]
    verdicts = hits.groupBy(*key).agg(longest.alias("best"), blocked.alias("blocked"))
    verdicts = verdicts.withColumnsRenamed({name: f"of_{name}" for name in key})
    same = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in key]
    return parts.join(verdicts, same, "left").select(
        *key,
        F.col("best.rule").alias("rule"),
        F.coalesce(
            F.col("best.rule_verdict"), F.when(F.col("blocked"), "block"), F.lit("allow")
        ).alias("verdict"),
    )

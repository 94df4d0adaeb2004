"""Sharding and URL rules."""

import itertools
import zlib

import pytest

from qarun.llm.shards import shard_by_bytes
from qarun.llm.url_rules import Rule, judge_urls, site_rule, word_rule
from tests.llm.helpers import docs


def test_shards_are_contiguous_balanced_and_gapless(spark):
    texts = ["é" * (i * 37 % 101) for i in range(500)] + [None, "", "x" * 5000, "same", "same"]
    ids = [(i * 7919) % 100_003 for i in range(505)]
    ids[-1] = ids[-2]
    got = sorted(shard_by_bytes(docs(spark, texts, ids), shards=8).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == sorted(ids)
    by_id = dict(zip(ids, texts, strict=True))
    for r in got:
        data = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    before = 0
    for r in got:
        assert r.shard == min(7, (2 * before + r.size) * 8 // (2 * total))
        before += r.size
    for _, rows in itertools.groupby(got, key=lambda r: r.shard):
        rows = list(rows)
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 8) <= largest


def test_shards_with_null_ids_and_no_rows(spark):
    got = shard_by_bytes(docs(spark, ["b", "a", None], [1, None, None]), shards=2).collect()
    assert sorted((r.shard, r.slot) for r in got) in ([(0, 0), (0, 1), (1, 0)], [(0, 0), (1, 0), (1, 1)])
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [None, None, 1]
    assert shard_by_bytes(docs(spark, [])).count() == 0


def pages(spark, urls):
    rows = [(i, url, "rule", "token") for i, url in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, token string")


CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://planet/x", "planet", "/x", None, "allow"),
    ("https://A.B.Example.NET/en/1?q#f", "a.b.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.example.com/den", "x.example.com", "/den", None, "allow"),
    ("http://wiki.org/fr/a#b", "wiki.org", "/fr/a", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x=/", "a.net", "", None, "allow"),
    ("http://a.net:80/x", "a.net:80", "/x", None, "allow"),
    ("a.net/x", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://x.com/see?u=http://a.net/", "x.com", "/see", None, "allow"),
    ("http://É.NET/x", "É.net", "/x", "net/", "block"),
    ("http://m.casino-win.example.com/en/", "m.casino-win.example.com", "/en/", None, "block"),
    ("http://x.com/FREE_bets/", "x.com", "/FREE_bets/", None, "block"),
    ("http://x.com/casinos", "x.com", "/casinos", None, "allow"),
    ("http://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"),
    ("http://x.com/a\nb", "x.com", "/a\nb", None, "allow"),
]


def test_urls(spark):
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages(spark, [c[0] for c in CASES])).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert judge_urls(pages(spark, [])).count() == 0


def test_repeated_rows_and_null_ids_keep_their_verdicts(spark):
    rows = [(None, "http://a.net/"), (None, "http://a.net/"), (None, "http://b.com/"), (1, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted((r.host, r.verdict) for r in judge_urls(df).collect()) == [
        ("", "allow"),
        ("a.net", "block"),
        ("a.net", "block"),
        ("b.com", "allow"),
    ]


def test_only_rules_under_a_token_of_the_url_run(spark):
    # This pattern would match everything, but is filed under a token that no URL has.
    rules = [Rule("all", "block", ".*", ("nowhere",)), word_rule("block", "spam"), site_rule("allow", "a.com/x")]
    got = judge_urls(pages(spark, ["http://spam.a.com/", "http://a.com/xyz"]), rules).collect()
    assert sorted((r.host, r.rule, r.verdict) for r in got) == [
        ("a.com", "a.com/x", "allow"),
        ("spam.a.com", None, "block"),
    ]
    with pytest.raises(ValueError, match="literal"):
        judge_urls(pages(spark, []), [Rule("none", "block", ".*", ())])

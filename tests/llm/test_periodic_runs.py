"""Periodic runs against a search of all periods, and suffix trees against plain comparison."""

import random
import zlib

import numpy as np
import pytest

from qarun.llm.periodic_runs import _stretches, kept_words, looped, numbered, periodic_runs, runs_of
from qarun.llm.queries import op13_periodic_runs
from qarun.llm.suffix_tree import SuffixTree
from tests.llm.helpers import docs, sha

SPACES = " \t\n\x0b\x0c\r"


def runs_by_hand(words):
    """Every maximal stretch of each period; of those with the same ends the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    inside = [
        (s, e - s, q)
        for (s, e), q in found.items()
        if not any(a <= s and e <= b and p < q for (a, b), p in found.items())
    ]
    return sorted(inside, key=lambda run: (run[0], run[2]))


def split(text):
    for space in SPACES[1:]:
        text = text.replace(space, " ")
    return [word for word in text.split(" ") if word]


def digest_by_hand(doc_id, text):
    words = split(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id,
        len(runs),
        *top,
        None if top[0] is None else 1000 * top[1] // top[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def awkward(rng):
    """A sequence over few words with repeats of several lengths in it."""
    k = rng.choice([1, 2, 2, 3, 5, 40])
    words = [rng.randrange(k) for _ in range(rng.randrange(60))]
    loop = [rng.randrange(k) for _ in range(rng.randrange(1, 15))]
    return words[:12] + loop * rng.randrange(5) + words[12:30] + loop * 2 + loop[:3] + words[30:]


def test_runs_by_hand():
    rng = random.Random(4)
    for _ in range(1500):
        words = awkward(rng)
        assert [tuple(run) for run in runs_of(words)] == runs_by_hand(words), words


def test_no_run_lies_outside_the_stretches():
    rng = random.Random(5)
    cut = 0
    for _ in range(500):
        words = awkward(rng)
        inside = _stretches(numbered(words))
        cut += sum(b - a for a, b in inside) < len(words)
        for s, m, _ in runs_by_hand(words):
            assert any(a <= s and s + m <= b for a, b in inside)
    assert cut > 100


def test_suffix_tree_against_plain_comparison():
    rng = random.Random(6)
    for _ in range(200):
        symbols = [rng.randrange(1, rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 40))]
        tree, n = SuffixTree(symbols), len(symbols)
        suffixes = [symbols[i:] for i in range(n + 1)]
        order = sorted(range(n + 1), key=lambda i: suffixes[i])
        assert [tree.rank[i] for i in order] == list(range(n + 1))
        order = sorted(range(n + 1), key=lambda i: [-x for x in suffixes[i]])
        assert [tree.reversed_rank()[i] for i in order] == list(range(n + 1))
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]).T
        want = []
        for i, j in zip(a, b, strict=True):
            same = 0
            while max(i, j) + same < n and symbols[i + same] == symbols[j + same]:
                same += 1
            want.append(same)
        assert tree.extension(a, b).tolist() == want


def test_kept_words_drop_all_but_the_first_period():
    words = list("xy") + list("abc") * 5 + ["z"]
    assert kept_words(words, runs_of(words)) == ["x", "y", "a", "b", "c", "z"]


def test_query_of_awkward_documents(spark, tmp_path):
    rng = random.Random(7)
    texts = [rng.choice(SPACES).join(f"w{x}" for x in awkward(rng)) for _ in range(150)]
    texts += [None, "", " \t\n", "one", "a b a b", "É é\x1f" + " x" * 30, "q " * 3000]
    texts += [" ".join(f"u{i}" for i in range(300))] * 6
    ids = [*range(len(texts) - 1), 3]
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    want = [digest_by_hand(i, text) for i, text in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(row[1] > 1 for row in want) and {row[0] for row in want if zlib.crc32(str(row[0]).encode()) % 10 == 0}


def test_query_of_the_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    # Searching all periods takes the square of the length, so long texts are left to the others.
    some = {r.doc_id: r.text for r in rows.collect() if r.text is None or len(r.text) < 6000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == rows.count() and len(some) > 100
    for doc_id, text in some.items():
        assert got[doc_id] == digest_by_hand(doc_id, text)


def test_null_ids_and_empty_tables(spark):
    loop = "a b c d e f " * 3
    found = periodic_runs(docs(spark, [loop, loop], [None, None]), change=looped).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        (None, 18, [(0, 18, 6)], "a b c d e f")
    ] * 2
    assert periodic_runs(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 11, 12, 13])
def test_shortest_run(n):
    assert len(runs_of(["a"] * n)) == (n >= 12)

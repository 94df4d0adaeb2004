"""Benchmark decontamination against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from qarun.llm.decontaminate import (
    MASKS,
    SUBSTITUTED,
    WINDOW,
    Contamination,
    contaminated,
    holding,
    without_contaminated,
    words_of,
)
from qarun.llm.stages import without_passages
from tests.llm.helpers import docs, words


def test_masks_reach_every_window():
    for gone in itertools.combinations(range(WINDOW), SUBSTITUTED):
        assert any(
            not {start + step for step in mask} & set(gone)
            for mask in MASKS
            for start in range(WINDOW - mask[-1])
        )


def holds(doc, item):
    if len(item) < 5:
        return False
    window = min(WINDOW, len(item))
    for start in range(-len(item), len(doc)):
        equal = [0 <= start + i < len(doc) and doc[start + i] == w for i, w in enumerate(item)]
        needed = window if len(item) < WINDOW else WINDOW - SUBSTITUTED
        if any(sum(equal[i : i + window]) >= needed for i in range(len(item) - window + 1)):
            return True
    return False


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [words(rng, n, 60) for n in (40, 25, 12, 11, 8, 5, 4, 1)] + ["", None]
    texts = [words(rng, 80, 60) for _ in range(25)] + [None, "", "w1"]
    for item in items[:8]:
        for swaps in (0, 1, 2, 3, 6, 12):
            w = item.split()
            for _ in range(min(swaps, len(w) - 1)):
                w[rng.randrange(len(w))] = "other"
            texts.append(f"{words(rng, 30, 60)} {' '.join(w).upper()}, {words(rng, 30, 60)}")
        texts.append("(" + item.replace(" ", "...\n") + ")")
    texts.append(" ".join(items[0].split()[5:17]))
    texts.append(" ".join(items[0].split()[5:15]))
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    table = docs(spark, texts)
    for block_seeds in (500_000, 20):
        found = contaminated(table, bench, block_seeds=block_seeds)
        got = {r.doc_id: list(r.item_ids) for r in found.collect()}
        want = {}
        for i, text in enumerate(texts):
            doc = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
            hit = [j for j, item in enumerate(items) if holds(doc, (item or "").split())]
            if hit:
                want[i] = hit
        assert got == want
    left = without_contaminated(table, found)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - set(want)


def test_a_passage_that_all_share_makes_no_pairs(spark):
    """Items and documents with the same 13 words: work grows with the rows, not with pairs."""
    shared = " ".join(f"p{i}" for i in range(13))
    n = 500
    own = [f"{shared} " + " ".join(f"{{}}{i}x{k}" for k in range(20)) for i in range(n)]
    bench = spark.createDataFrame([(i, t.replace("{}", "b")) for i, t in enumerate(own)], "item_id long, text string")
    table = docs(spark, [t.replace("{}", "d") for t in own] + ["none of it"])
    found = Contamination(table, bench, "doc_id", "text", "item_id", "text", 500_000)
    assert found._hit_keys.count() < 66 * 10 * (n + 100)
    assert found.matched.count() < 12 * n
    held = holding(table, bench)
    assert {r.doc_id for r in held.collect()} == set(range(n))


def test_holding_is_the_same_without_items(spark):
    rng = random.Random(12)
    items = [words(rng, n, 40) for n in (30, 12, 11, 6)]
    texts = [words(rng, 60, 40) for _ in range(10)] + [items[0][5:], items[1], f"x {items[2]} y", items[3], None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = docs(spark, texts)
    want = sorted((r.doc_id, r.text_hash) for r in contaminated(table, bench).collect())
    assert sorted(map(tuple, holding(table, bench, block_seeds=9).collect())) == want and len(want) >= 4


def test_hits_of_a_long_text_carry_no_text(spark):
    """Each of 60,000 words is hit; with the whole text beside each hit that is over 50 GB."""
    rng = random.Random(5)
    item = words(rng, 12)
    text = " ".join([item] * 5_000)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = contaminated(docs(spark, [text, "rain", f"{words(rng, 9_000)} {item}"]), bench)
    assert sorted((r.doc_id, list(r.item_ids)) for r in found.collect()) == [(0, [7]), (2, [7])]


def test_the_stage_takes_long_texts_full_of_passages(spark):
    """As above, for the documents that stay: a passage of 12 words that three words keep apart."""
    rng = random.Random(6)
    item = words(rng, 12)
    apart = " ".join(w if i % 4 else "other" for i, w in enumerate(item.split()))
    texts = [" ".join([item] * 5_000), " ".join([apart, words(rng, 12)] * 3_000), None]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    table = docs(spark, texts)
    left = without_passages(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id: r.text for r in left.collect()} == dict(enumerate(texts[1:], 1))


def test_pieces_of_any_length_find_the_same(spark):
    rng = random.Random(8)
    items = [words(rng, n, 50) for n in (20, 12, 11, 7, 5)]
    texts = [f"{words(rng, n, 50)} {item} {words(rng, 15, 50)}" for n in range(14) for item in items]
    texts += [" ".join(items[0].split()[:10]), " ".join(items[0].split()[-10:]), *items, "w1 w2 w3 w4", None]
    # Two words swapped, so windows at the ends of an item and of a text count as well.
    texts += [" ".join("other" if i in (3, 8) else w for i, w in enumerate(t.split())) for t in texts[:40]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = docs(spark, texts)

    def of(piece_words):
        seen = Contamination(table, bench, "doc_id", "text", "item_id", "text", 500_000, piece_words)
        rows = seen.windows.join(seen.links, "window").collect()
        return {(r.doc_id, r.text_hash, tuple(r.window), r.item_id) for r in rows}

    whole = of(10_000)
    want = {
        (i, j)
        for i, text in enumerate(texts)
        for j, item in enumerate(items)
        if holds((text or "").split(), item.split())
    }
    assert {(id, item_id) for id, _, _, item_id in whole} == want
    for piece_words in (1, 5, 13):
        assert of(piece_words) == whole


def test_null_ids_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = docs(spark, [item, "clean words only", item, item + " x"], [None, None, 4, 4])
    left = without_contaminated(table, contaminated(table, bench))
    assert [r.text for r in left.collect()] == ["clean words only"]
    assert contaminated(docs(spark, []), bench).count() == 0
    assert contaminated(table, bench.limit(0)).count() == 0
    assert without_contaminated(table, contaminated(table, bench.limit(0))).count() == 4


def test_scripts_without_spaces(spark):
    han = "春天的時候村裡的人都到河邊去看花開"
    kana = "きのうカタカナのほんをよんだ"
    thai = "ภาษาไทยไม่มีช่องว่างระหว่างคำ"
    bench = spark.createDataFrame([(0, han), (1, kana), (2, thai)], "item_id long, text string")
    texts = [f"他說{han}，然後走了", f"{han[:6]}某{han[7:]}", f"x{kana}y", f"ก่อน{thai}หลัง", han[:8], "한국어 문장 하나", "rain"]
    found = contaminated(docs(spark, texts), bench).collect()
    assert {r.doc_id: list(r.item_ids) for r in found} == {0: [0], 1: [0], 2: [1], 3: [2]}
    row = spark.sql("SELECT 'Ab-C 12 กำ日本x é' AS t").select(words_of(F.col("t")).alias("w")).first()
    assert list(row.w) == ["ab", "c", "12", "ก", "ำ", "日", "本", "x", "é"]

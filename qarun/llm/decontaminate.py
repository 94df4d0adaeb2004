"""Benchmark decontamination by spaced seeds, with a look at the words around each hit."""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import Kept, as_text, by_place, lent

# Positions that count in a seed; the others may hold any word. Of any twelve words with at
# most two substitutions at least one of these seeds stays whole (checked in the tests).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW = 12
SUBSTITUTED = 2
# Shorter items say too little to be looked for.
MIN_WORDS = 5
# Seeds of the benchmark that one block holds: a table of some 50 MB in each executor.
BLOCK_SEEDS = 2_000_000
# Places of a text that are looked at together; what they hit is in memory at once.
PIECE_WORDS = 2_048
# Words that a window can reach to either side of a hit.
REACH = WINDOW - 1


# Fixed value: scripts written without spaces between words, such as Thai, Lao, Burmese, Khmer,
# Japanese and Chinese.
UNSPACED = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19DF}\x{1A20}-\x{1AAF}"
    r"\x{3005}-\x{3007}\x{3040}-\x{312F}\x{31A0}-\x{31BF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}"
    r"\x{4E00}-\x{9FFF}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}"
    r"\x{20000}-\x{3FFFF}"
)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; single characters in unspaced scripts."""
    lower = F.lower(text)
    # Most texts have none of these; to see that is cheaper than to replace.
    spaced = F.when(
        lower.rlike(f"[{UNSPACED}]"),
        F.regexp_replace(lower, f"([{UNSPACED}&&[\\p{{L}}\\p{{N}}]]\\p{{M}}*)", " $1 "),
    ).otherwise(lower)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{M}\p{N}]+"), "")


def _seeds(words: Column, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """The hash of each mask laid on ``words`` from place ``at``; null if it does not fit."""
    return F.array(
        *[
            F.when(
                at + mask[-1] < F.size(words),
                F.xxhash64(F.lit(str(mask)), *[F.get(words, at + step) for step in mask]),
            )
            for mask in masks
        ]
    )


def _pieces(docs: DataFrame, id: str, text: str, piece_words: int) -> DataFrame:
    """``doc_id, text_hash, piece``: the words of every text, ``piece_words`` in a row.

    A piece also has the ``REACH`` words before and after it; words before a text are null.
    """
    ahead = F.array_repeat(F.lit(None).cast("string"), REACH)
    starts = F.when(
        F.size("words") >= REACH + MIN_WORDS,
        F.sequence(F.lit(1), F.size("words") - REACH, F.lit(piece_words)),
    )
    pieces = F.transform(starts, lambda at: F.slice("words", at, F.lit(piece_words + 2 * REACH)))
    return docs.select(
        F.col(id).alias("doc_id"),
        F.xxhash64(as_text(text)).alias("text_hash"),
        F.concat(ahead, words_of(as_text(text))).alias("words"),
    ).select("doc_id", "text_hash", F.explode(pieces).alias("piece"))


def _hits(pieces: DataFrame, seeds: DataFrame, masks: list, piece_words: int) -> DataFrame:
    """``doc_id, text_hash, around, mask``: where ``mask`` on a text gives one of ``seeds``.

    ``around`` has the word there in the middle and at most ``REACH`` to either side. A row has
    no more of the text, as all rows that one piece gives are in memory at once.
    """
    places = F.sequence(
        F.lit(REACH), F.least(F.lit(piece_words) + REACH, F.size("piece")) - F.lit(1)
    )
    return (
        pieces.select("doc_id", "text_hash", "piece", F.explode(places).alias("at"))
        .select(
            "doc_id",
            "text_hash",
            "piece",
            "at",
            F.posexplode(_seeds(F.col("piece"), F.col("at"), masks)).alias("mask", "seed"),
        )
        .filter(F.col("seed").isNotNull())
        .join(F.broadcast(seeds), "seed", "left_semi")
        .select(
            "doc_id",
            "text_hash",
            F.slice("piece", F.col("at") - REACH + 1, F.lit(2 * REACH + 1)).alias("around"),
            "mask",
        )
    )


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Distinct items of at least ``MIN_WORDS`` words."""
    words = words_of(as_text(item_text)).alias("item")
    items = benchmark.select(F.col(item_id).alias("item_id"), words)
    return items.filter(F.size("item") >= MIN_WORDS).distinct()


def _item_windows(items: DataFrame) -> DataFrame:
    """``item_id, window``: all windows of an item, or a short one as a whole."""
    last = F.greatest(F.size("item") - WINDOW, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda at: F.slice("item", at + 1, F.lit(WINDOW))
    )
    return items.select("item_id", F.explode(F.array_distinct(windows)).alias("window"))


def _keys(window: Column) -> Column:
    """Keys of a window: two windows share one if all words but ``SUBSTITUTED`` agree.

    Each way to leave out that many of ``WINDOW`` words gives a key, null where it would have to
    hold a word that is missing. A shorter window has its words as its only key.
    """
    left_out = [*combinations(range(WINDOW), SUBSTITUTED)]
    ways = F.lit([list(way) for way in left_out])

    def key(way: Column) -> Column:
        held = F.transform(window, lambda w, at: F.when(F.array_contains(way, at), "").otherwise(w))
        two = F.struct(F.xxhash64(way, held).alias("h1"), F.xxhash64(held, way).alias("h2"))
        return F.when(~F.exists(held, lambda w: w.isNull()), two)

    whole = F.struct(
        F.xxhash64(F.size(window), window).alias("h1"), F.xxhash64(window, F.size(window)).alias("h2")
    )
    many = F.array_compact(F.transform(ways, key))
    return F.when(F.size(window) == WINDOW, many).otherwise(F.array(whole))


class Contamination:
    """What of ``benchmark`` is in ``docs``, without a row per pair.

    ``windows`` has ``doc_id, text_hash, window``: the windows of documents around seed hits.
    ``matched`` has ``window`` for those that agree with a window of an item. ``links`` has
    ``window, item_id`` for them, as many rows as there are items to a distinct window.
    """

    def __init__(
        self, docs, benchmark, id, text, item_id, item_text, block_seeds, piece_words=PIECE_WORDS
    ):
        kept = Kept(docs.sparkSession)
        items = kept.keep(_items(benchmark, item_id, item_text), "items")
        item_windows = kept.keep(_item_windows(items), "item-windows")
        distinct = kept.keep(item_windows.select("window").distinct(), "distinct-item-windows")
        short = distinct.select(F.size("window").alias("n")).distinct().filter(F.col("n") < WINDOW)
        whole = [tuple(range(row.n)) for row in short.collect()]  # lengths below WINDOW
        masks = [*MASKS, *sorted(whole)]
        lengths = F.lit([WINDOW] * len(MASKS) + [len(mask) for mask in masks[len(MASKS) :]])
        spans = F.lit([mask[-1] + 1 for mask in masks])

        # The seeds alone: where they come from is found out for distinct windows only.
        at = F.explode(F.sequence(F.lit(0), F.size("window") - 1)).alias("at")
        seeds = kept.keep(
            distinct.select("window", at)
            .select("window", "at", F.posexplode(_seeds(F.col("window"), F.col("at"), masks)))
            .toDF("window", "at", "mask", "seed")
            .filter(F.col("seed").isNotNull() & (F.get(lengths, "mask") == F.size("window")))
            .select("seed")
            .distinct(),
            "seeds",
        )
        blocks = max(1, -(-seeds.count() // block_seeds))

        pieces = _pieces(docs, id, text, piece_words)
        found = None
        for block in range(blocks):
            part = seeds.filter(F.pmod(F.xxhash64("seed", F.lit("block")), F.lit(blocks)) == block)
            hits = _hits(pieces, part, masks, piece_words)
            found = hits if found is None else found.unionByName(hits)

        # The windows that a seed can lie in; words beyond the ends of a text are null.
        size = F.get(lengths, "mask")
        first = F.lit(REACH) - (size - F.get(spans, "mask"))
        start = F.explode(F.sequence(first, F.lit(REACH)))
        reach = F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)
        inside = F.transform(reach, lambda i: F.get("around", i))
        missing = F.size(F.filter("window", lambda w: w.isNull()))
        self.windows = kept.keep(
            found.select("doc_id", "text_hash", "around", size.alias("size"), start.alias("start"))
            .select("doc_id", "text_hash", inside.alias("window"))
            .filter(missing <= SUBSTITUTED)
            .distinct(),
            "hit-windows",
        )
        keys = F.explode(_keys(F.col("window"))).alias("key")
        # Few distinct windows of items share a key, however many items have the window.
        of_windows = kept.keep(distinct.select("window", keys), "item-keys")
        known = lent(of_windows.select("key").distinct())
        # Most windows around hits agree with none; their keys go no further than the scan.
        self._hit_keys = kept.keep(
            self.windows.select("window")
            .distinct()
            .select("window", keys)
            .join(known, "key", "left_semi"),
            "hit-keys",
        )
        self._of_items = item_windows.join(of_windows, "window").select("key", "item_id")
        self.matched = self._hit_keys.select("window").distinct()

    @property
    def links(self) -> DataFrame:
        of_items = self._of_items.distinct()
        return self._hit_keys.join(of_items, "key").select("window", "item_id").distinct()


def holding(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """One row per document that holds a benchmark passage: ``doc_id, text_hash``.

    As ``contaminated``, but which items they are is not looked up, so the work grows with the
    documents and items, also where all of them share a passage.
    """
    found = Contamination(docs, benchmark, id, text, item_id, item_text, block_seeds)
    return found.windows.join(found.matched, "window").select("doc_id", "text_hash").distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """One row per document that holds a benchmark passage: ``doc_id, text_hash, item_ids``.

    A document holds an item if, laid on each other at some place, ``WINDOW`` words in a row
    differ in at most ``SUBSTITUTED``. An item with fewer words must be there whole and
    unchanged, and one with fewer than ``MIN_WORDS`` is not looked for. Words are runs of
    letters and digits in lower case, so punctuation and line ends do not matter. In scripts
    without spaces each character, with its marks, is a word.

    ``text_hash`` (xxhash64 of the text) tells rows with the same or a null id apart. Null and
    empty texts hold nothing, null or repeated items are no special case, and empty tables
    give no rows. Other columns are not read. Long texts are read whole and looked at in pieces of
    ``PIECE_WORDS``, so memory follows the length of a text and not its hits times its length.

    The distinct seeds of the benchmark, eight bytes each, are cut into blocks of about
    ``block_seeds``. A block is broadcast and meets the seeds of all documents in the scan, so
    their texts are never shuffled; a benchmark of any size takes more scans, not more memory.
    The windows around hits are then verified, each distinct one once, by keys that leave
    ``SUBSTITUTED`` words out: a common seed leads to as many keys as there are windows, never to
    pairs of windows. Items are looked up last, for distinct windows; a document is given all of
    its items, so the rows written grow with the true links (see ``holding`` for none of them).
    """
    found = Contamination(docs, benchmark, id, text, item_id, item_text, block_seeds)
    return (
        found.windows.join(found.links, "window")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )


def without_contaminated(
    docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not in ``found``, a result of ``contaminated`` or ``holding``.

    Rows keep all their columns as they are, whatever these are called. Null ids and texts are
    matched as such, and of rows that share an id only those with a text in ``found`` go.
    """
    bare, place = by_place(docs)
    gone = found.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    same = (F.col(place[id]).eqNullSafe(F.col("of_id"))) & (
        F.xxhash64(as_text(place[text])) == F.col("of_hash")
    )
    return bare.join(lent(gone), same, "left_anti").toDF(*docs.columns)

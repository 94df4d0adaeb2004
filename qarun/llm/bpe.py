"""BPE encoding and decoding by way of a table of distinct words."""

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qarun.llm.common import Kept, as_text

# Words whose ids all tasks hold, some 300 bytes each in a Python worker.
TABLE_WORDS = 300_000
# Words that a counting task holds before it hands on its counts, and other words that
# an encoding task remembers.
TASK_WORDS = 200_000

# Characters for which Python's own classes split words as the tokenizer's pattern does.
_PLAIN = re.compile(
    "[\t\n\r -~¡-©«-±´-¸»¿-įı-ɏ"
    "‐-―‘-„†-•…€]*"
)
# Fixed value: how the vocabulary of words with word ends splits lower-case text.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Vocabulary:
    """A tokenizer file taken apart: how it splits, and how it encodes one word.

    It must lower-case and split by its own pattern, encode words apart from each
    other, and have no decoder, so that pieces are joined by one space.
    """

    def __init__(self, content: str):
        parts = json.loads(content)
        normalizer, split = parts["normalizer"], parts["pre_tokenizer"]["pretokenizers"]
        if parts["decoder"] is not None or [p["type"] for p in split] != ["Split", "ByteLevel"]:
            raise ValueError("expected a pattern split, byte-level words and no decoder")
        if [n["type"] for n in normalizer["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("expected NFC, white space and lower case as normalizers")
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.plain_split = split[0]["pattern"]["Regex"] == (
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        )
        whole = Tokenizer.from_str(content)
        self.pieces = {i: piece for piece, i in whole.get_vocab(with_added_tokens=True).items()}
        self.normalizer = whole.normalizer
        only_split = parts | {"pre_tokenizer": split[0]}
        self.splitter = Tokenizer.from_str(json.dumps(only_split)).pre_tokenizer
        alone = parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": split[1]}
        self.words_only = Tokenizer.from_str(json.dumps(alone))
        marks = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = re.compile(f"({marks})") if marks else None

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.marks is None or not self.marks.search(text):
            return self._words(text)
        words: list[str] = []
        for i, part in enumerate(self.marks.split(text)):
            words += [part] if i % 2 else self._words(part)
        return words

    def _words(self, text: str) -> list[str]:
        if self.plain_split and _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        normal = self.normalizer.normalize_str(text)
        return [word for word, _ in self.splitter.pre_tokenize_str(normal)]

    def encode(self, word: str) -> list[int]:
        """The ids of one word or special token."""
        if word in self.special:
            return [self.special[word]]
        return self.words_only.encode(word, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


class _Memo(dict):
    """Ids (packed) or pieces (joined) by word; words outside the table are added for a while."""

    def __init__(self, known: dict, make):
        super().__init__(known)
        self.make, self.more = make, {}

    def __missing__(self, word: str):
        value = self.more.get(word)
        if value is None:
            if len(self.more) >= TASK_WORDS:
                self.more.clear()
            value = self.more[word] = self.make(word)
        return value


def word_counts(docs: DataFrame, content: str, text: str = "text") -> DataFrame:
    """``word, n``: every distinct word and special token, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = _vocabulary(content), Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.string())
            numbers = pa.array(list(counts.values()), pa.int64())
            return pa.RecordBatch.from_arrays([words, numbers], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                counts.update(vocabulary.split(value.as_py()))
                if len(counts) >= TASK_WORDS:
                    yield handed()
                    counts.clear()
        yield handed()

    parts = docs.select(as_text(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, content: str) -> DataFrame:
    """``word, ids``: each row's word encoded."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for batch in batches:
            ids = [vocabulary.encode(word) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"]
            )

    return words.select("word").mapInArrow(encode, "word string, ids array<int>")


def decode_ids(rows: DataFrame, content: str, key: str, ids: str = "ids") -> DataFrame:
    """``key, decoded``: the pieces of each row's ids joined by one space, empty without ids.

    Pieces come from a join with the vocabulary, one row per id in it.
    """
    vocabulary = _vocabulary(content)
    pieces = rows.sparkSession.createDataFrame(
        pa.table(
            {
                "id": pa.array(list(vocabulary.pieces), pa.int32()),
                "piece": pa.array(list(vocabulary.pieces.values())),
            }
        )
    )
    placed = rows.select(key, F.posexplode_outer(ids).alias("at", "id"))
    # The vocabulary is as large as its file, a few MB.
    return (
        placed.join(F.broadcast(pieces), "id", "left")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("found"))
        .select(key, F.array_join("found.piece", " ").alias("decoded"))
    )


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``; words of like frequency go in together."""
    band = F.floor(8 * F.log2("n")).cast("int").alias("band")
    bands = counts.groupBy(band).agg(F.count(F.lit(1)).alias("words")).collect()  # some hundreds
    least, total = None, 0
    for row in sorted(bands, reverse=True):
        total += row.words
        if total > most:
            break
        least = row.band
    return counts.filter(F.lit(False) if least is None else band >= least)


def encode(
    docs: DataFrame,
    content: str,
    id: str = "doc_id",
    text: str = "text",
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids, decoded``.

    ``content`` is the text of a tokenizer file (see ``Vocabulary``). ``ids`` are those the
    tokenizer gives for the whole text without adding special tokens, where strings of special
    tokens in the text count as such; ``decoded`` is what it decodes them to, special tokens
    included.

    Null and empty texts have no ids and decode to an empty text. Ids may be null or
    repeat; every row is encoded. An empty table gives no rows; other columns are not read.

    Words are split and counted over all texts. The frequent ones, at most ``table_words``,
    form a table in which each is encoded once and decoded through a join of its ids with
    the vocabulary. That table, bounded by its parameter, goes to all tasks, which put ids
    and pieces in the places of the words. A word outside the table is encoded where it
    stands: bringing it in by a join would shuffle every whole text.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    counts = kept.keep(word_counts(docs, content, text), "word-counts")
    table = kept.keep(encode_words(_frequent(counts, table_words), content), "words")
    found = table.join(decode_ids(table, content, "word"), "word").toArrow()
    shared = spark.sparkContext.broadcast(
        (
            found.column("word").to_pylist(),
            [np.array(ids, np.int32).tobytes() for ids in found.column("ids").to_pylist()],
            found.column("decoded").to_pylist(),
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        words, packed, joined = shared.value

        def pack(word: str) -> bytes:
            return np.array(vocabulary.encode(word), np.int32).tobytes()

        def join(word: str) -> str:
            return " ".join(vocabulary.pieces[i] for i in vocabulary.encode(word))

        ids_of = _Memo(dict(zip(words, packed, strict=True)), pack)
        text_of = _Memo(dict(zip(words, joined, strict=True)), join)
        for batch in batches:
            # Long texts grow some five times; a few at a time keep memory flat.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                buffers, decoded = [], []
                for value in part.column(1):
                    found = vocabulary.split(value.as_py())
                    buffers.append(b"".join(map(ids_of.__getitem__, found)))
                    decoded.append(" ".join(map(text_of.__getitem__, found)))
                ends = np.cumsum([0, *[len(b) // 4 for b in buffers]]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(buffers), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, ids), pa.array(decoded)],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id).alias("doc_id"), as_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``encode``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer file of the driver's; it travels with the tasks from there."""
    with open(path, encoding="utf-8") as file:
        return file.read()

"""BPE against the tokenizer itself."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from qarun.llm.bpe import Vocabulary, decode_ids, digests, encode, read_vocabulary
from tests.llm.helpers import docs, sha

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello World's I'M 12 x_y é “q” ###",
    None,
    "",
    " \n\t",
    "<|startoftext|>Foo  bar<|endoftext|> x<|endoftext|>",
    "ΑΣ ΟΔΟΣ İstanbul ẞ ﬁ é ẛ̣ ½ ² Ⅷ ª µ",
    "日本語テキスト です 한국어 \x1c \x85 \xa0 a b",
    "emoji \U0001f469‍\U0001f467 \U0001f1e9\U0001f1ea",
    "\x00\x01ctrl a\x0bb\x0cc",
    "don't we'll they'VE 's 't' '''d",
    "a" * 5000,
    "word " * 30_000,
    "same text",
    "same text",
]


@pytest.mark.parametrize("table_words", [300_000, 20, 0])
def test_same_as_the_tokenizer(spark, table_words):
    whole, content = Tokenizer.from_file(PATH), read_vocabulary(PATH)
    ids = [None, 3, 3, *range(4, 4 + len(TEXTS) - 3)]
    encoded = encode(docs(spark, TEXTS, ids), content, table_words=table_words)
    want = []
    for i, text in zip(ids, TEXTS, strict=True):
        tokens = whole.encode(text or "", add_special_tokens=False).ids
        decoded = whole.decode(tokens, skip_special_tokens=False)
        want.append((i, len(tokens), sha(" ".join(map(str, tokens))), sha(decoded)))
    assert sorted(map(tuple, digests(encoded).collect()), key=repr) == sorted(want, key=repr)
    assert encode(docs(spark, []), content, table_words=table_words).count() == 0


def test_decode_joins_pieces_in_order(spark):
    content = read_vocabulary(PATH)
    whole = Tokenizer.from_file(PATH)
    rows = [(1, [3306, 1002, 568, 49407, 3306]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    got = {r.k: r.decoded for r in decode_ids(df, content, "k").collect()}
    assert got == {1: whole.decode(rows[0][1], skip_special_tokens=False), 2: "", 3: ""}


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        Vocabulary(read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))

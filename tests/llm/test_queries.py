"""The registered queries against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from qarun.llm import queries
from qarun.llm.queries import op10_shards, op3_decontaminate, op9_near_dedup
from tests.llm.helpers import docs, sha
from tests.llm.test_dedup import family, lines_by_hand, near_by_hand

SF_DIR = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def lies_in(doc, item):
    """Ten of twelve words in a row agree somewhere, for items of twelve words at least."""
    places = defaultdict(list)
    for at, word in enumerate(doc):
        places[word].append(at)
    shifts = Counter(at - i for i, word in enumerate(item) for at in places[word])
    for shift in (s for s, n in shifts.items() if n >= 10):
        equal = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        if any(sum(equal[i : i + 12]) >= 10 for i in range(len(item) - 11)):
            return True
    return False


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows_as_sql(spark, duck, name):
    ours = queries.queries()[name](spark, SF_DIR)
    theirs = duck.execute(queries.oracle_sql()[name])
    columns = sorted(column[0] for column in theirs.description)
    places = [[c[0] for c in theirs.description].index(name) for name in columns]
    expected = sorted(([row[i] for i in places] for row in theirs.fetchall()), key=repr)
    assert sorted(ours.columns) == columns and expected
    assert sorted(map(list, ours.select(columns).collect()), key=repr) == expected


def test_near_dedup_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    # All pairs take long, so those that share a shingle rarely are told apart by length first.
    got = op9_near_dedup(spark, SF_DIR).collect()
    ids, texts = zip(*rows, strict=True)
    assert sorted(map(tuple, got)) == near_by_hand(ids, texts, 3, 85)


def test_shards_of_the_test_table(spark):
    got = op10_shards(spark, SF_DIR).collect()
    sizes = [sum(r.size for r in got if r.shard == shard) for shard in range(40)]
    assert len(got) == 1000 and max(sizes) - min(sizes) < 2 * max(r.size for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_contaminated_documents_of_the_test_table(spark, duck):
    plain = """
        SELECT DISTINCT doc_id FROM documents d, benchmark b
        WHERE contains(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}]+', ' ', 'g'),
                       trim(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]+', ' ', 'g')))"""
    whole = {row[0] for row in duck.execute(plain).fetchall()}
    flagged = {r.doc_id for r in op3_decontaminate(spark, SF_DIR).collect() if r.contaminated}
    assert whole and whole <= flagged and len(flagged) <= 1.1 * len(whole)


def test_stages_of_the_pipeline(spark):
    texts = family(5, 6, length=60, edits=3) + ["\n".join(["a line that all of these hold", f"own words number {i}"]) for i in range(4)]
    texts += [None, "", "clean and short"]
    table = docs(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near-dedup", "decontamination", "BPE"]

    lined = stages["line dedup"](spark, table.selectExpr("*", "1L AS n_chars"), SF_DIR)
    want = {i: text for i, _, _, text in lines_by_hand(list(enumerate(texts)))}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    near = stages["near-dedup"](spark, table, SF_DIR)
    kept = {i for i, _, _, kept in near_by_hand(range(len(texts)), texts, 5, 80) if kept}
    assert {r.doc_id for r in near.collect()} == kept and near.columns == table.columns

    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    dirty = docs(spark, [item, f"Before. {item} After.", "clean words", None])
    left = stages["decontamination"](spark, dirty, SF_DIR)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3] and left.columns == dirty.columns

    insulting = docs(spark, ["You are an idiot, a moron and pathetic scum, stupid clown.", "A quiet day.", None])
    left = stages["toxicity"](spark, insulting, "/root/testdata/sf0.1")
    assert sorted(r.doc_id for r in left.collect()) == [1, 2] and left.columns == insulting.columns


def test_near_dedup_stage_decides_by_row(spark):
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    a, b, c = "a b c d e f g", "q r s t u v w", "k l m n o p i j"
    cases = [
        # Copies of a text, also with repeated and null ids, leave one row.
        ([a, a, a], [3, 3, None], [(3, a)]),
        ([a, a], [None, None], [(None, a)]),
        # The other text of a repeated id stays.
        ([a, b, b], [3, 3, 2], [(3, a), (2, b)]),
        ([a, a, b, c, c], [None, 3, 3, 3, 1], [(3, a), (3, b), (1, c)]),
        # Empty texts are no copies.
        ([None, "", " ", a, a], [5, 5, 5, 6, 6], [(5, None), (5, ""), (5, " "), (6, a)]),
    ]
    for texts, ids, want in cases:
        table = docs(spark, texts, ids)
        left = stage(spark, table, SF_DIR)
        assert left.columns == table.columns
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


# Names that stages use inside, or that Spark reads in another way.
CLASHES = (
    "own_hash", "of_id", "of_hash", "of_number", "_gone_id", "_gone_hash", "a.b", "count", "row",
    "gone", "doc", "text_hash", "n_lines", "n_dropped", "kept", "component_id", "score", "c0", "c1",
    "n_chars", "seed", "words", "key", "h1", "of`x",
)


@pytest.mark.parametrize("ids", [range(8), [0, 0, 1, 1, 2, 3, None, None]])
def test_stages_keep_columns_of_any_name(spark, ids):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    same = "the same words in both of these rows again"
    texts = [same, same, "x y z", None, f"Before. {item} After.", "stupid scum, moron, idiot", "", "q r s t"]
    own = [c for c in CLASHES if c != "n_chars"]
    rows = [
        (i, t, *[f"{n} {c}" for c in own], len(t or ""))
        for n, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in own)
    table = spark.createDataFrame(rows, f"doc_id long, text string, {fields}, n_chars long").repartition(3)
    want = {row[2]: row for row in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, table, SF_DIR)
        assert left.columns == table.columns, name
        got = [tuple(row) for row in left.collect()]
        assert len({row[2] for row in got}) == len(got) >= 4, name
        for row in got:
            text = want[row[2]][1]
            assert row == (*want[row[2]][:1], (text or "") if name == "line dedup" else text, *want[row[2]][2:])
    encoded = corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR)
    assert encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert encoded.count() == 8


def test_stages_of_empty_tables(spark):
    table = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, table, SF_DIR)
        assert left.count() == 0 and (name == "BPE" or left.columns == table.columns)


def test_whole_pipeline_by_hand(spark):
    """Every row against plain versions of the stages, each over what the one before left."""
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    model = queries.toxicity_model(spark, sf_dir)
    left = [(r.doc_id, r.text) for r in rows if model.score(r.text) < queries.DECISION]
    left = [(i, text) for i, _, _, text in lines_by_hand(left)]
    near = near_by_hand(*zip(*left, strict=True), 5, 80)
    kept = {i for i, _, _, kept in near if kept}
    left = [(i, text) for i, text in left if i in kept]
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert min(map(len, items)) >= 12
    left = [(i, text) for i, text in left if not any(lies_in(words(text), item) for item in items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = []
    for i, text in left:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r.doc_id for r in got}
    assert len(ids) == len(got) and 100 < len(got) < 200
    assert all(len(r.ids_sha256) == 64 and r.n_tokens >= 0 for r in got)

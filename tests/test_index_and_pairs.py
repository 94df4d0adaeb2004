"""Row index by key and turn pairing against plain Python, on awkward keys."""

import datetime
import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from qarun.operators import index, pair_turns, with_row_index
from qarun.plans import recorded_results

SCHEMA = "conv_id long, turn long, role string, text string"


def first_nulls(value):
    return (value is not None, value)


def made_turns(seed, hot_share=0.4, n=900):
    """Conversations with gaps between turns, one of them holding a large share."""
    rng = random.Random(seed)
    keys = set()
    while len(keys) < n:
        if rng.random() < hot_share:
            keys.add((77, rng.randrange(5 * n)))
        else:
            keys.add((rng.randrange(-40, 300) * 10**rng.randrange(12), rng.randrange(-2, 9)))
    roles = ["user", "assistant", "system", "user"]
    return [(c, t, rng.choice(roles), f"{c}/{t}") for c, t in keys]


def paired(rows):
    """What the pairing should give, by a walk over the sorted rows."""
    rows = sorted(rows)
    out = []
    for here, after in zip(rows, [*rows[1:], None], strict=True):
        conv, turn, role, text = here
        if role != "user":
            continue
        good = after is not None and after[0] == conv and after[2] == "assistant"
        out.append((conv, turn, "ok" if good else "error", text, after[3] if good else None))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bits", [0, 2, 5, 12])
def test_pairs_do_not_depend_on_block_size(spark, seed, bits):
    rows = made_turns(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = recorded_results(df, bits).select(
        "row_index", "conv_id", "turn", "status", "question", "response"
    )
    expected = [(i, *row) for i, row in enumerate(paired(rows))]
    assert sorted(map(tuple, got.collect())) == expected


def test_pairs_without_broadcast(spark):
    rows = made_turns(9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = recorded_results(df, 3).select(
            "row_index", "conv_id", "turn", "status", "question", "response"
        )
        assert sorted(map(tuple, got.collect())) == [
            (i, *row) for i, row in enumerate(paired(rows))
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_system_turn_is_not_a_question_and_not_an_answer(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "system", "x")]
    got = pair_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.turn, r.status, r.phase, r.response) for r in got] == [(1, "error", "ask", None)]


def test_turn_numbers_far_apart(spark):
    rng = random.Random(3)
    roles = ["user", "assistant"]
    rows = [(7, t, rng.choice(roles), f"{t}") for t in rng.sample(range(10**12), 3000)]
    got = recorded_results(spark.createDataFrame(rows, SCHEMA), 4).select(
        "row_index", "conv_id", "turn", "status", "question", "response"
    )
    assert sorted(map(tuple, got.collect())) == [(i, *row) for i, row in enumerate(paired(rows))]


def test_columns_of_pairs(spark):
    df = pair_turns(spark.createDataFrame(made_turns(1), SCHEMA))
    assert df.columns == ["conv_id", "turn", "status", "phase", "question", "response"]


@pytest.mark.parametrize("parallelism", ["1", "3", "16"])
def test_index_by_long_keys(spark, parallelism):
    rng = random.Random(4)
    sources = [None, "a", "b", "b", "b"]
    keys = {(rng.choice(sources), rng.randrange(-(2**62), 2**62)) for _ in range(800)}
    keys |= {("b", i) for i in range(500)} | {(None, None), ("a", None)}
    df = spark.createDataFrame([(*k, "x") for k in keys], "source string, id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parallelism)
    try:
        got = with_row_index(df, ["source", "id"], bits=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    ordered = sorted(keys, key=lambda k: (first_nulls(k[0]), first_nulls(k[1])))
    assert sorted((r.row_index, r.source, r.id) for r in got) == [
        (i, *k) for i, k in enumerate(ordered)
    ]


@pytest.mark.parametrize("with_null", [False, True])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_counts_in_many_sorted_parts(spark, monkeypatch, with_null, threshold):
    seen = []

    def kept(df, name):
        seen.append(written(df, name))
        return seen[-1]

    written = index.written
    monkeypatch.setattr(index, "written", kept)
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "13",
        "spark.sql.autoBroadcastJoinThreshold": threshold,
    }
    own = F.concat(F.lit("s"), "id")
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(own).alias("source"),
        (F.col("id") * 7919 % 20_011).alias("id"),
    )
    if with_null:
        df = df.withColumn("source", F.nullif("source", F.lit("hot")))
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = with_row_index(df, ["source", "id"], bits=5).collect()
        [counts] = [table for table in seen if "_part" in table.columns]
        assert counts.select("_part").distinct().count() == 13
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = sorted(got, key=lambda r: (first_nulls(r.source), r.id))
    assert [r.row_index for r in rows] == list(range(20_000))


def test_index_by_text_and_by_time(spark):
    words = [f"w{i:03}" for i in range(300)]
    random.Random(1).shuffle(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    timed = df.withColumn("at", F.timestamp_seconds(F.expr("int(substr(word, 2))")))
    for order in ("word", ["at"]):
        got = with_row_index(timed, order).orderBy("row_index").collect()
        assert [(r.row_index, r.word) for r in got] == list(enumerate(sorted(words)))


ORDERS = {
    "text": ("string", lambda rng, i: f"http://host/{'ab'[i % 2] * (i % 4 * 9)}/{rng.randrange(10**6)}é"),
    "time": ("timestamp", lambda rng, i: EPOCH + datetime.timedelta(seconds=rng.randrange(10 ** (i % 9)), microseconds=i)),
    "naive": ("timestamp_ntz", lambda rng, i: EPOCH + datetime.timedelta(minutes=rng.randrange(10 ** (i % 6)), microseconds=i)),
    "fraction": ("double", lambda rng, i: rng.choice([1 + i * 1e-9, rng.gauss(0, 1) * 10 ** (i % 30 - 15)])),
    "number": ("bigint", lambda rng, i: rng.choice([i, rng.randrange(-(2**63), 2**63)])),
    "decimal": ("decimal(20,6)", lambda rng, i: decimal.Decimal(rng.randrange(10 ** (i % 12))).scaleb(-6)),
    "day": ("date", lambda rng, i: (EPOCH + datetime.timedelta(days=rng.randrange(10 ** (i % 5)))).date()),
}
EPOCH = datetime.datetime(2001, 2, 3)


@pytest.mark.parametrize("name", ORDERS)
def test_buckets_of_every_type_follow_the_order(spark, monkeypatch, name):
    """Half of the rows share their first key; no bucket is larger than it may be, none is a row."""
    tables = []
    monkeypatch.setattr(index, "written", lambda df, n, w=index.written: tables.append(w(df, n)) or tables[-1])
    kind, value = ORDERS[name]
    rng = random.Random(8)
    keys = list({value(rng, i) for i in range(1500)}) + [None]
    if name == "fraction":
        keys += [float("nan"), float("inf"), -float("inf"), 0.0]
    rows = [(i % 2 * i, key) for i, key in enumerate(keys)]
    df = spark.createDataFrame(rows, f"first long, `last` {kind}").repartition(4)
    for order in (["last", "first"], ["first", "last"]):
        tables.clear()
        got = with_row_index(df, order, bits=6).orderBy("row_index").collect()
        ordered = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
        assert [r.row_index for r in got] == list(range(len(rows)))
        assert repr([(r.first, r["last"]) for r in got]) == repr([(r.first, r["last"]) for r in ordered])
        [counts] = [table for table in tables if "_n" in table.columns]
        sizes = [row["_n"] for row in counts.collect()]
        assert max(sizes) <= 64 and sum(sizes) == len(rows)
    assert len(sizes) < len(rows) / 2 or name == "text"  # few share their first letters


def test_many_small_keys_share_buckets(spark, monkeypatch):
    """As many conversations as rows take no bucket each."""
    tables = []
    monkeypatch.setattr(index, "written", lambda df, n, w=index.written: tables.append(w(df, n)) or tables[-1])
    df = spark.range(1_000_000).selectExpr("id div 2 AS conv", "id % 2 AS turn")
    got = with_row_index(df, ["conv", "turn"])
    [counts] = [table for table in tables if "_n" in table.columns]
    assert counts.count() < 70_000
    wrong = got.filter(F.col("row_index") != F.col("conv") * 2 + F.col("turn"))
    assert wrong.count() == 0


def test_index_of_nothing(spark):
    assert with_row_index(spark.createDataFrame([], "id long"), ["id"]).count() == 0


def exchanges(df, *columns):
    """How many shuffles of the plan that ran carry all the named columns."""
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    text = df._jdf.queryExecution().explainString(modes.fromString("formatted"))
    tree = text.split("== Initial Plan ==")[0]
    numbers = re.findall(r"- Exchange \((\d+)\)", tree)
    inputs = [re.search(rf"\n\({n}\) Exchange\nInput[^\n]*", text)[0] for n in numbers]
    return sum(all(f"{column}#" in line for column in columns) for line in inputs)


def test_pairing_and_numbering_share_one_shuffle_of_the_text(spark, tmp_path):
    path = str(tmp_path / "conversations")
    spark.createDataFrame(made_turns(5), SCHEMA).filter("turn < 4096").write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = recorded_results(spark.read.parquet(path))
        df.collect()
        assert exchanges(df, "text") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_task_gets_a_whole_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(4000)]
    rows += [(c, 0, "user", "x") for c in range(2, 500)]
    df = pair_turns(spark.createDataFrame(rows, SCHEMA), keep_block=True, bits=6)
    sizes = df.groupBy("conv_id", "block").count().agg(F.max("count")).first()[0]
    assert sizes <= 2**6
    assert df.filter("status = 'ok'").count() == 2000


def test_columns_with_names_of_helpers_come_back(spark, tmp_path):
    names = "_range _place _start _id _path _offset _first _part _n __n".split()
    df = spark.createDataFrame([(i, *range(len(names))) for i in range(5)], ["id", *names])
    got = with_row_index(df, ["id"])
    assert got.columns == ["id", *names, "row_index"]
    assert sorted(map(tuple, got.collect())) == [(i, *range(len(names)), i) for i in range(5)]
    df.coalesce(1).write.csv(str(tmp_path / "t"), header=True)
    got = with_row_index(spark.read.csv(str(tmp_path / "t"), header=True))
    assert got.columns == ["id", *names, "row_index"] and got.count() == 5

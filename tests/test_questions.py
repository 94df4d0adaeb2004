"""CSV scan and question column, on small files."""

import csv
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from qarun.operators import with_row_index
from qarun.scratch import scratch, shared_dir
from qarun.sources import (
    QuestionColumnError,
    read_question_sets,
    read_questions,
    resolve_question,
)
from qarun.sources.questions import line_options

THREE = ["Which river runs through the old town?", "Where can I hand in a lost key?"]
THREE += ["Is the library open on Mondays?"]


def put(tmp_path, text, name="questions.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def questions(spark, path, **options):
    return resolve_question(read_questions(spark, path), **options)


def kind(spark, path):
    """The options for files that are all of one kind."""
    [(options, _)] = line_options(spark, [path])
    return options


def texts(df):
    return [row.question for row in df.collect()]


@pytest.mark.parametrize("header", ["question", "questions", "q"])
def test_accepted_names(spark, tmp_path, header):
    path = put(tmp_path, "\n".join([header, *THREE]) + "\n")
    assert texts(questions(spark, path)) == THREE


@pytest.mark.parametrize("header", [" question ", "Question", "QUESTIONS "])
def test_near_names_need_normalize(spark, tmp_path, header):
    path = put(tmp_path, f"{header}\nwhy\n")
    with pytest.raises(QuestionColumnError, match="Could not find a question column"):
        questions(spark, path)
    assert texts(questions(spark, path, normalize=True)) == ["why"]


def test_message_lists_the_columns(spark, tmp_path):
    with pytest.raises(QuestionColumnError, match=r"found \['text', 'id'\]"):
        questions(spark, put(tmp_path, "text,id\nwhy,1\n"))


def test_precedence(spark, tmp_path):
    assert texts(questions(spark, put(tmp_path, "q,question\nleft,right\n"))) == ["right"]
    assert texts(questions(spark, put(tmp_path, "q,questions\nleft,right\n"))) == ["right"]


@pytest.mark.parametrize("normalize", [False, True])
def test_two_equal_headers_fail(spark, tmp_path, normalize):
    with pytest.raises(QuestionColumnError):
        questions(spark, put(tmp_path, "q,q\na,b\n"), normalize=normalize)


def test_two_columns_equal_after_normalizing_fail(spark, tmp_path):
    with pytest.raises(QuestionColumnError):
        questions(spark, put(tmp_path, "q, q\na,b\n"), normalize=True)


def test_other_case_column_gives_way(spark, tmp_path):
    df = questions(spark, put(tmp_path, "Question,q\nother,why\n"))
    assert df.columns == ["Question_", "question"]
    assert texts(df) == ["why"]


def test_empty_file_fails_and_header_only_is_valid(spark, tmp_path):
    with pytest.raises(QuestionColumnError):
        questions(spark, put(tmp_path, "", "empty.csv"))
    assert texts(questions(spark, put(tmp_path, "q\n", "header.csv"))) == []
    assert with_row_index(questions(spark, put(tmp_path, "q\n", "h2.csv"))).count() == 0


def test_values_stay_as_they_are(spark, tmp_path):
    values = ["two\nlines", "a, b", 'say "hi"', "  spaced  ", "crlf\r\nkept", "\ttab"]
    quoted = ['"' + v.replace('"', '""') + '"' for v in values]
    path = put(tmp_path, "\n".join(["q", *quoted]) + "\n")
    assert kind(spark, path) == {"multiLine": True}
    assert texts(questions(spark, path)) == values


def test_split_only_when_no_value_spans_lines(spark, tmp_path):
    flat = put(tmp_path, 'q,n\n"a ""quoted"" word, and more",1\nplain,2\n"",3\n')
    assert kind(spark, flat) == {"multiLine": False}
    assert texts(questions(spark, flat)) == ['a "quoted" word, and more', "plain", None]


def test_extra_column_and_blank_cells(spark, tmp_path):
    df = with_row_index(questions(spark, put(tmp_path, "id,question\n1,a\n2,\n3,b\n4,\n")))
    rows = sorted((r.row_index, r.id, r.question) for r in df.collect())
    assert rows == [(0, "1", "a"), (1, "2", None), (2, "3", "b"), (3, "4", None)]


def test_wholly_empty_line_takes_no_index(spark, tmp_path):
    for name, multi_line in (("one.csv", False), ("two.csv", True)):
        path = put(tmp_path, 'q\na\n\n""\nb\n', name)
        df = with_row_index(resolve_question(read_questions(spark, path, multi_line)))
        assert sorted((r.row_index, r.question) for r in df.collect()) == [
            (0, "a"),
            (1, None),
            (2, "b"),
        ]


@pytest.mark.parametrize("multi_line", [False, True])
def test_byte_order_mark_and_crlf(spark, tmp_path, multi_line):
    path = put(tmp_path, "question\r\nwhy\r\nhow\r\n", encoding="utf-8-sig")
    df = resolve_question(read_questions(spark, path, multi_line))
    assert texts(df) == ["why", "how"]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    put(tmp_path, "question,id\nwhy,1\n", "a.csv")
    put(tmp_path, "id,question\n2,how\n", "b.csv")
    with pytest.raises(Exception, match="(?i)header"):
        questions(spark, str(tmp_path)).select("question").collect()


def test_files_are_numbered_in_path_order(spark, tmp_path):
    put(tmp_path, "q\n" + "".join(f"a{i}\n" for i in range(3)), "a.csv")
    put(tmp_path, "q\n" + "".join(f"b{i}\n" for i in range(2000)), "b.csv")
    df = with_row_index(questions(spark, str(tmp_path)))
    expected = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(2000)]
    assert texts(df.orderBy("row_index")) == expected
    assert [r.row_index for r in df.orderBy("row_index").collect()] == list(range(2003))


@pytest.mark.parametrize("split", ["1000", "4096", "128m"])
def test_index_does_not_depend_on_splits(spark, tmp_path, split):
    sizes = {"a": 700, "b": 5000, "c": 1}
    for name, rows in sizes.items():
        put(tmp_path, "q\n" + "".join(f"{name}{i}\n" for i in range(rows)), f"{name}.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        scan = questions(spark, str(tmp_path))
        assert split == "128m" or scan.rdd.getNumPartitions() > 3
        got = [(r.row_index, r.question) for r in with_row_index(scan).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = [f"{name}{i}" for name, rows in sizes.items() for i in range(rows)]
    assert sorted(got) == list(enumerate(expected))


def test_csv_round_trip(spark, tmp_path):
    values = ["plain", " edge ", 'q"uote', "new\nline", "comma,", "ünï", None]
    rows = [(i, v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "id int, question string")
    path = str(tmp_path / "out")
    table.coalesce(1).write.csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    back = with_row_index(questions(spark, path))
    assert sorted((r.row_index, int(r.id), r.question) for r in back.collect()) == [
        (i, i, v) for i, v in rows
    ]


def test_odd_column_names_survive_the_index(spark, tmp_path):
    df = with_row_index(questions(spark, put(tmp_path, '"a b;(c)",q," d,e"\n1,why,2\n')))
    assert df.columns == ["a b;(c)", "question", " d,e", "row_index"]
    assert df.select(F.col("`a b;(c)`")).first()[0] == "1"


def test_shuffled_rows_are_not_numbered_by_file(spark, tmp_path):
    put(tmp_path, "q\n" + "".join(f"{i}\n" for i in range(500)), "a.csv")
    df = questions(spark, str(tmp_path))
    with pytest.raises(Exception, match="index the scan itself"):
        with_row_index(df.repartition(4)).collect()
    kept = with_row_index(df.filter("question % 2 = 0")).collect()
    assert sorted((r.row_index, int(r.question)) for r in kept) == [(i, 2 * i) for i in range(250)]


def test_spreadsheets_are_refused(spark):
    with pytest.raises(ValueError, match="save the sheet as CSV"):
        read_questions(spark, "questions.xlsx")


SPLIT, WHOLE = {"multiLine": False}, {"multiLine": True}
SPLIT_CRLF, WHOLE_CRLF = SPLIT | {"lineSep": "\r\n"}, WHOLE | {"lineSep": "\r\n"}


@pytest.mark.parametrize(
    ("end", "inside", "options"),
    [
        ("\n", [], SPLIT),
        ("\r\n", [], SPLIT),
        ("\n", ["\n"], WHOLE),
        ("\n", ["\n", "\r\n", "\r"], WHOLE),
        ("\r\n", ["\n"], SPLIT_CRLF),
        ("\r\n", ["\n", "\r-"], SPLIT_CRLF),
        ("\r\n", ["\r\n"], WHOLE_CRLF),
    ],
)
def test_random_values_come_back(spark, tmp_path, end, inside, options):
    rng = random.Random(11)
    letters = ["a", "b ", ",", '"', '""', " ", "é", ";", "\t", *inside]
    expected = []
    for name in ("a.csv", "b.csv"):
        values = ["x" + "".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(400)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=end).writerows([["n", "q"], *enumerate(values)])
        expected += values
    assert kind(spark, str(tmp_path)) == options
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = questions(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 2  # values with line ends are split, too
        rows = with_row_index(scan).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.row_index, r.question) for r in rows) == list(enumerate(expected))


def test_lines_of_white_space_are_rows(spark, tmp_path):
    path = put(tmp_path, 'q\na\n  \n"  "\n\t\n\nb\n')
    assert texts(questions(spark, path)) == ["a", "  ", "  ", "\t", "b"]
    assert with_row_index(questions(spark, path)).count() == 5


def test_line_ends_may_differ_between_files(spark, tmp_path):
    put(tmp_path, 'q\r\n"a\nb"\r\nc\r\n', "a.csv")
    put(tmp_path, 'q\n"d\ne"\nf\n', "b.csv")
    df = with_row_index(questions(spark, str(tmp_path))).orderBy("row_index")
    assert texts(df) == ["a\nb", "c", "d\ne", "f"]


def test_last_line_without_an_end(spark, tmp_path):
    path = put(tmp_path, 'id,q\r\n1,"two\nlines"\r\n\r\n2,end', encoding="utf-8-sig")
    assert kind(spark, path) == SPLIT_CRLF
    assert texts(questions(spark, path)) == ["two\nlines", "end"]


@pytest.mark.parametrize(
    "text",
    [
        'q,n\n5" disk,1\n6" disk,2\n',
        'q,n\n5","open\nclose",5"\nplain,1\n',
        'q,n\n "a\nb",1\n',
        'q,n\n"a"b,1\n"c" ,2\n',
        'q,n\n"""a""",1\n"","""\n"""\n',
    ],
)
def test_odd_quoting_is_read_like_a_whole_file(spark, tmp_path, text):
    path = put(tmp_path, text)
    whole = read_questions(spark, path, multi_line=True).collect()
    assert kind(spark, path) == WHOLE
    assert read_questions(spark, path).collect() == whole


def test_a_very_long_line(spark, tmp_path):
    value = 'word, "" ' * 300_000
    path = put(tmp_path, f'q,n\n"{value}",1\n' + "x," * 200_000 + "\n")
    assert kind(spark, path) == SPLIT


def test_a_file_is_read_the_same_whatever_lies_beside_it(spark, tmp_path):
    put(tmp_path, "q\n" + "".join(f"a{i}\n" for i in range(3000)), "a plain+[1] ü%20.csv")
    put(tmp_path, 'q\n"b\r\nkept"\n"b\nkept"\n', "b.csv")
    put(tmp_path, 'q\r\n"c\r\nkept"\r\nc\r\n', "c.csv")
    put(tmp_path, 'q\r\n"d\nkept"\r\nd\r\n', "d.csv")
    put(tmp_path, "", "e.csv")
    found = {tuple(sorted(o.items())): len(f) for o, f in line_options(spark, [str(tmp_path)])}
    assert found == {tuple(sorted(o.items())): 1 for o in (SPLIT, WHOLE, SPLIT_CRLF, WHOLE_CRLF)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = questions(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 6  # the plain file is still split
        df = with_row_index(scan)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert df.columns == ["question", "row_index"]
    rest = ["b\r\nkept", "b\nkept", "c\r\nkept", "c", "d\nkept", "d"]
    expected = [*(f"a{i}" for i in range(3000)), *rest]
    assert sorted((r.row_index, r.question) for r in df.collect()) == list(enumerate(expected))


def test_a_file_that_would_change_is_refused_by_name(spark, tmp_path):
    put(tmp_path, "q\nfine\n", "a.csv")
    put(tmp_path, 'q\r\n"one\r\ntwo\nthree"\r\n5" disk\r\n', "bad.csv")
    with pytest.raises(ValueError, match=r"bad\.csv"):
        questions(spark, str(tmp_path))


def test_values_with_both_line_ends_come_back(spark, tmp_path):
    put(tmp_path, "q\nfine\n", "a.csv")
    put(tmp_path, 'q\r\n"one\r\ntwo\nthree"\r\n\r\n"four\r"\r\n', "b.csv")
    df = with_row_index(questions(spark, str(tmp_path)))
    got = sorted((r.row_index, r.question) for r in df.collect())
    assert got == [(0, "fine"), (1, "one\r\ntwo\nthree"), (2, "four\r")]


@pytest.fixture
def small_splits(spark):
    """Splits of so many bytes."""

    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [60, 300, 5000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_rows_are_split_anywhere(spark, tmp_path, small_splits, split, end):
    """Also inside of values that are longer than a split, and of the header."""
    rng = random.Random(split)
    letters = ["a", "b ", ",", '"', '""', " ", "é", "\n", "\r\n", "\r", "\n\n", "q,n"]
    expected = []
    for name in ("a.csv", "b.csv"):
        sizes = [rng.choice([0, 1, 10, 10, 200]) for _ in range(150)]
        values = ["x" + "".join(rng.choices(letters, k=k)) for k in sizes]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            header = ["n", "q", "a long\nname, in\nmany lines " + "of words\n" * 20]
            rows = [[i, v, ""] for i, v in enumerate(values)]
            csv.writer(out, lineterminator=end).writerows([header, *rows])
        expected += [(str(i), v) for i, v in enumerate(values)]
    small_splits(split)
    frame = questions(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() > 2 and header[2] in frame.columns
    got = sorted((r.row_index, r.n, r.question) for r in with_row_index(frame).collect())
    assert got == [(i, *row) for i, row in enumerate(expected)]


def test_large_odd_files_are_read_whole(spark, tmp_path, small_splits):
    text = 'q,n\n5","open\nclose",5"\n' + "plain,1\n" * 300 + '"open\n'
    path = put(tmp_path, text)
    whole = read_questions(spark, path, multi_line=True).collect()
    small_splits(500)
    assert kind(spark, path) == WHOLE
    assert read_questions(spark, path).collect() == whole


def test_large_files_with_other_headers_are_refused(spark, tmp_path, small_splits):
    for name, header in (("a.csv", "q,id"), ("b.csv", "id,q")):
        put(tmp_path, header + "\n" + '"a\nb",c\n' * 300, name)
    small_splits(500)
    with pytest.raises(ValueError, match="header"):
        questions(spark, str(tmp_path))


def test_the_index_of_files_copies_no_text(spark, tmp_path, small_splits):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    for name, text in (("flat", "q\n" + "word\n" * 900), ("ends", 'q\n' + '"wo\nrd"\n' * 900)):
        path = put(tmp_path, text, f"{name}.csv")
        small_splits(700)
        before = set(folder.glob("qarun-*"))
        with scratch(spark):
            indexed = with_row_index(questions(spark, path))
            made = set(folder.glob("qarun-*")) - before
            tables = {p.name.split("-", 1)[1]: spark.read.parquet(str(p)) for p in made}
            assert indexed.count() == 900 and tables
            for table_name, table in tables.items():
                # Only rows that cross a split are kept, each once.
                assert "question" not in table.columns and "value" not in table.columns
                assert table_name.startswith("crossing-rows") or "text" not in table.columns
                assert table.count() < 60


def test_other_splits_are_an_error_and_no_wrong_index(spark, tmp_path, small_splits):
    path = put(tmp_path, "q\n" + "".join(f"{i}\n" for i in range(2000)))
    small_splits(1000)
    indexed = with_row_index(questions(spark, path))
    small_splits(1300)
    with pytest.raises(Exception, match="split in another way"):
        indexed.collect()


def test_files_may_name_the_question_differently(spark, tmp_path):
    put(tmp_path, "id,q\n1,why\n2,how\n", "b.csv")
    put(tmp_path, '"a b.c","question",Note\r\nx,"when\nat night",y\r\n', "a.csv")
    put(tmp_path, "\ufeffid,q\n3,who\n", "c.csv")
    put(tmp_path, "\n\nquestions,q,note\nwhere,not this,n\n", "d.csv")
    put(tmp_path, '"question","in two\nlines"\nwhat,z\n', "e.csv")
    put(tmp_path, "", "f.csv")
    frame = with_row_index(read_question_sets(spark, str(tmp_path)))
    rows = sorted(frame.collect(), key=lambda row: row.row_index)
    assert [row.row_index for row in rows] == list(range(6))
    asked = ["when\nat night", "why", "how", "who", "where", "what"]
    assert [row.question for row in rows] == asked
    assert [row.id for row in rows] == [None, "1", "2", "3", None, None]
    assert [row["a b.c"] for row in rows] == ["x"] + [None] * 5
    assert [row["note"] for row in rows] == ["y", None, None, None, "n", None]
    assert [row["q"] for row in rows] == [None] * 4 + ["not this", None]
    assert rows[5]["in two\nlines"] == "z"


def test_a_set_without_a_question_column_is_named(spark, tmp_path):
    put(tmp_path, "q\nwhy\n", "a.csv")
    put(tmp_path, "Q\nhow\n", "b.csv")
    with pytest.raises(QuestionColumnError, match=r"found \['Q', '_metadata'\] in .*b\.csv"):
        read_question_sets(spark, str(tmp_path))
    rows = with_row_index(read_question_sets(spark, str(tmp_path), normalize=True)).collect()
    assert sorted((r.row_index, r.question) for r in rows) == [(0, "why"), (1, "how")]


def test_large_quoted_files_may_have_different_headers(spark, tmp_path, small_splits):
    for name, header in (("a.csv", "q,id"), ("b.csv", "id,question"), ("c.csv", "q,id")):
        body = "".join(f'"{name}\n{i}","{name}\n{i}"\n' for i in range(300))
        put(tmp_path, header + "\n" + body, name)
    rows = with_row_index(read_question_sets(spark, str(tmp_path))).collect()
    assert len(rows) == 900 and all(row.question == row.id for row in rows)
    rows.sort(key=lambda row: row.row_index)
    want = [f"{name}\n{i}" for name in ("a.csv", "b.csv", "c.csv") for i in range(300)]
    assert [row.question for row in rows] == want

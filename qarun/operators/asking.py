"""Sessions and asking: run a caller's responder over a table of questions."""

import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import partial
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qarun.schema import ASK, ERROR, OK, START_SESSION

OUTCOME = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
OUTCOME_ARROW = pa.schema(
    [
        ("session_id", pa.string()),
        ("ts", pa.timestamp("us", tz="UTC")),
        ("status", pa.string()),
        ("phase", pa.string()),
        ("response", pa.string()),
        ("error", pa.string()),
    ]
)

# Rows that are answered before they go on: few enough to see a log grow.
CHUNK = 200


def with_session(df: DataFrame, run_id: str) -> DataFrame:
    """Add ``session_id``: one key per row, the same each time the plan runs."""
    return df.withColumn("session_id", F.concat_ws("-", F.lit(run_id), F.col("row_index")))


def _said(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


def _opened(open_session: Callable[[], str]) -> str:
    opened = open_session()
    if opened is None or str(opened) == "":
        raise ValueError("open_session gave no session key")
    return str(opened)


def _ask_one(
    session_id: str | None,
    question: str | None,
    responder: Callable[[str, str], str],
    open_session: Callable[[], str] | None,
) -> tuple:
    """The values of OUTCOME for one question."""
    phase, status, response, error = START_SESSION, ERROR, None, None
    try:
        if open_session is not None:
            session_id = None
            session_id = _opened(open_session)
        phase = ASK
        answer = responder(session_id, question)
        response = None if answer is None else str(answer)
        status = OK
    except Exception as failure:  # a bad row becomes an error record
        error = _said(failure)
    return session_id, datetime.now(UTC), status, phase, response, error


def _ask_many(
    session_ids: list[str | None],
    questions: list[str | None],
    responder: Callable[[list[str], list[str]], Sequence[str | Exception | None]],
    open_session: Callable[[], str] | None,
) -> list[tuple]:
    """The values of OUTCOME for the questions of one call."""
    sessions, unopened = list(session_ids), {}
    if open_session is not None:
        for i in range(len(sessions)):
            sessions[i] = None
            try:
                sessions[i] = _opened(open_session)
            except Exception as failure:
                unopened[i] = failure
    asked = [i for i in range(len(sessions)) if i not in unopened]
    answers: Sequence[str | Exception | None] = []
    if asked:
        try:
            answers = list(responder([sessions[i] for i in asked], [questions[i] for i in asked]))
            if len(answers) != len(asked):
                raise ValueError(f"{len(answers)} answers to {len(asked)} questions")
        except Exception as failure:  # nobody knows which row it was
            answers = [failure] * len(asked)
    answered = dict(zip(asked, answers, strict=True))
    now = datetime.now(UTC)
    outcomes = []
    for i, session_id in enumerate(sessions):
        phase = START_SESSION if i in unopened else ASK
        answer = unopened[i] if i in unopened else answered[i]
        if isinstance(answer, Exception):
            outcomes.append((session_id, now, ERROR, phase, None, _said(answer)))
        else:
            response = None if answer is None else str(answer)
            outcomes.append((session_id, now, OK, phase, response, None))
    return outcomes


def _tasks(rows: DataFrame, per_task: int) -> int | None:
    """Tasks that ``rows`` are to be spread over, or None if they lie well as they are.

    They do if they fill as many parts and none holds over twice its share. The driver
    gets three numbers; parts are counted where they are.
    """
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    n, most, filled = parts.agg(total, F.max("n"), F.count("n")).first()
    if n == 0:
        return None
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, n), ceil(n / per_task))
    return None if filled >= tasks and most <= 2 * ceil(n / tasks) else tasks


def _free(name: str, taken: set[str]) -> str:
    """``name`` with as many underscores behind it as it takes to be new."""
    while name.lower() in taken:
        name += "_"
    return name


def ask(
    df: DataFrame,
    responder: Callable,
    open_session: Callable[[], str] | None = None,
    parallelism: int | None = None,
    concurrency: int = 1,
    questions_per_task: int | None = None,
    questions_per_call: int | None = None,
) -> DataFrame:
    """Add ``session_id, ts, status, phase, response, error`` to a table with ``question``.

    ``responder(session_id, question)`` is called once per row on the executors; when
    ``open_session`` is given it is called first and its key replaces ``session_id``.
    A row whose call raises, or whose session has no key, becomes an ``error`` record with the
    exception's type and whole message, and does not stop the job.

    Other columns stay. One with the name of an added column, in any letter case, gets an
    underscore behind its name.

    ``parallelism`` is the number of tasks (default: the cores of the cluster) and
    ``concurrency`` the number of calls a task has under way at a time; more than one
    needs a responder that is safe to call from several threads.

    With ``questions_per_task`` the number of tasks grows with the questions instead, which are
    counted first, and rows that are spread well enough already are not shuffled.

    With ``questions_per_call`` the responder takes a list of sessions and one of questions, at
    most that many, and gives as many answers in the same order; an exception among them stands
    for the failure of its row. If the call raises or gives another number of answers, all its rows
    are ``error`` records. Rows without a session are not part of a call. None is asked twice.

    Rows with a ``row_index`` are asked in its order within a task when they have been spread.

    Spark may run a task again, so a responder can see a question twice. Keep
    speculation off, write the result once, and report on what was written.
    """
    if open_session is None and "session_id" not in df.columns:
        raise ValueError("ask needs a session_id column or open_session")
    if open_session is not None and "session_id" not in df.columns:
        df = df.withColumn("session_id", F.lit(None).cast("string"))
    if df.sparkSession.conf.get("spark.speculation", "false") == "true":
        warnings.warn("spark.speculation is on: some questions may be asked twice", stacklevel=2)
    if parallelism is not None and questions_per_task is not None:
        raise ValueError("give parallelism or questions_per_task, not both")
    for size in (questions_per_task, questions_per_call):
        if size is not None and size < 1:
            raise ValueError("questions_per_task and questions_per_call must be at least 1")
    own = [name for name in df.columns if name != "session_id"]
    added = {name.lower() for name in OUTCOME.names}
    others = {name.lower() for name in own} - added
    renamed = {}
    for name in own:
        renamed[name] = _free(name, added | others) if name.lower() in added else name
        others.add(renamed[name].lower())

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    # By place, as a header like `S.No.` is no name that Spark can look up.
    places = [f"c{i}" for i in range(len(own))]
    columns = [quoted(name).alias(place) for name, place in zip(own, places, strict=True)]
    rows = df.select("session_id", *columns)
    schema = T.StructType([*rows.schema.fields[1:], *OUTCOME.fields])
    at = own.index("question") + 1
    one = partial(_ask_one, responder=responder, open_session=open_session)
    many = partial(_ask_many, responder=responder, open_session=open_session)
    size = questions_per_call
    chunk = CHUNK if size is None else size * concurrency

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            each = map if concurrency == 1 else pool.map
            for batch in batches:
                for start in range(0, batch.num_rows, chunk):
                    part = batch.slice(start, chunk)
                    sessions, questions = part.column(0).to_pylist(), part.column(at).to_pylist()
                    if size is None:
                        outcomes = list(each(one, sessions, questions))
                    else:
                        calls = range(0, len(questions), size)
                        called = each(
                            many,
                            [sessions[i : i + size] for i in calls],
                            [questions[i : i + size] for i in calls],
                        )
                        outcomes = [outcome for call in called for outcome in call]
                    new = [
                        pa.array([outcome[i] for outcome in outcomes], field.type)
                        for i, field in enumerate(OUTCOME_ARROW)
                    ]
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=schema.names)

    # By row_index the spread is even and the same each time a task is run again.
    tasks = parallelism or df.sparkSession.sparkContext.defaultParallelism
    if questions_per_task is not None:
        tasks = _tasks(rows, questions_per_task)
    keys = [places[own.index("row_index")]] if "row_index" in own else []
    if tasks is not None:
        rows = rows.repartition(tasks, *keys)
        rows = rows.sortWithinPartitions(*keys) if keys else rows
    answered = rows.mapInArrow(answer, schema)
    return answered.toDF(*[renamed[name] for name in own], *OUTCOME.names)

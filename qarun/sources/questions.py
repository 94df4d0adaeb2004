"""Question tables: CSV scan and choice of the question column."""

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from qarun.schema import NO_QUESTION_COLUMN, QUESTION_COLUMNS
from qarun.sources.quoted import pinned, quoted_rows, read_quoted, rehomed, well_formed


class QuestionColumnError(ValueError):
    """No column, or no single column, holds the questions."""


# One whole CSV row and nothing else. No part gives back what it took, so a check takes
# one pass over a line and no stack, however long the line is.
_FIELD = r'(?:(?:"[^"]*+")++|[^",\r\n]*+)'
WHOLE_ROW = rf"^{_FIELD}(?:,{_FIELD})*+\z"


# How a kind of file is read.
QUOTING = {"quote": '"', "escape": '"'}
PLAIN = {"multiLine": False}
SPLIT_AT_CRLF = {"multiLine": False, "lineSep": "\r\n"}
WHOLE_CRLF = {"multiLine": True, "lineSep": "\r\n"}
WHOLE = {"multiLine": True}
BY_QUOTES = {"byQuotes": True}


def _pattern(file: str) -> str:
    """A path that names just the file whose URI Spark gave."""
    return re.sub(r"[\\*?\[\]{}]", r"\\\g<0>", unquote(file))


def _by_file(
    spark: SparkSession, paths: Sequence[str], facts: dict[str, Column], **options: str
) -> dict[str, Row]:
    """One row per file with facts about its lines; files without a line are left out.

    A fact may use ``at``, which orders the lines of a file's first block.
    """
    line = F.monotonically_increasing_id()
    lines = spark.read.options(**options).text(paths)
    lines = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("_metadata.file_block_start") == 0, line).alias("at"),
    )
    found = lines.groupBy("file").agg(*[fact.alias(name) for name, fact in facts.items()])
    # One short row per file, as many as the names that Spark's own file listing holds.
    return {row.file: row for row in found.collect()}


def line_options(spark: SparkSession, paths: Sequence[str]) -> list[tuple[dict, list[str]]]:
    """Kinds of files, each with the options by which they are read right, in splits if possible.

    A file whose lines are all whole rows is split at line ends. One with line ends in its
    values that has more than one split is put together to rows by the quotes before each line,
    see ``quoted``, if every row is well-formed then. A smaller one with rows that end in CR LF,
    as spreadsheets save them, is split there if values hold only other line ends. Others are
    read whole, each in one task. What one file holds does not change how another is read.

    Rows that end in CR LF with values that hold both CR LF and single LF only come back
    unchanged by their quotes; if such a file is not well-formed it is refused by name. The
    check is one scan of the plain lines, and up to three more of the files it finds unfit.
    """
    kinds, _, _ = _kinds(spark, paths)
    return [(options, list(map(_pattern, files))) for options, files in kinds]


def _kinds(
    spark: SparkSession, paths: Sequence[str]
) -> tuple[list[tuple[dict, list[str]]], DataFrame | None, dict[str, str]]:
    """Kinds of files, the rows of those that are read by quotes, and each file's first line."""
    value = F.col("value")
    written_on = F.when(~value.rlike(r"^[\x00-\x20]*\z"), F.col("at"))
    # Spark skips lines of white space alone when it splits a file. They are rows.
    unfit = F.bool_or(~value.rlike(WHOLE_ROW) | value.rlike(r"^[\x00-\x20]+\z"))
    facts = {"unfit": unfit, "split": F.bool_or(F.col("at").isNull())}
    first = _by_file(spark, paths, {**facts, "header": F.min_by(value, written_on)})
    plain, split, whole_crlf, whole = [], [], [], []
    plain += [file for file, row in first.items() if not row.unfit]
    rest = [file for file, row in first.items() if row.unfit]
    large = [file for file in rest if first[file].split]
    rows = quoted_rows(spark, list(map(_pattern, large))) if large else None
    quoted = well_formed(rows, WHOLE_ROW) if large else []
    rest = sorted(set(rest) - set(quoted))
    refused = []
    if rest:
        ends = F.endswith(value, F.lit("\r"))
        by_lf = _by_file(
            spark,
            list(map(_pattern, rest)),
            {"any_cr": F.bool_or(ends), "header_cr": F.min_by(ends, "at")},
            lineSep="\n",
        )
        whole += [file for file, row in by_lf.items() if not row.any_cr]
        some = [file for file, row in by_lf.items() if row.any_cr]
        facts = {"unfit": unfit, "lf": F.bool_or(F.contains(value, F.lit("\n")))}
        unsure = [_pattern(file) for file in some]
        by_crlf = _by_file(spark, unsure, facts, lineSep="\r\n") if some else {}
        for file, row in by_crlf.items():
            if not row.unfit:
                split.append(file)
            elif not row.lf:
                whole_crlf.append(file)
            elif not by_lf[file].header_cr:
                whole.append(file)
            else:
                refused.append(file)
    if refused:
        more = well_formed(quoted_rows(spark, list(map(_pattern, refused))), WHOLE_ROW)
        for file in set(refused) - set(more):
            raise ValueError(
                f"rows of {file} end in CR LF, values hold both CR LF and LF, and not all rows "
                "are well-formed: save it with rows that end in LF"
            )
        quoted += more
    if refused or len(quoted) < len(large):
        rows = quoted_rows(spark, list(map(_pattern, quoted))) if quoted else None
    kinds = [(PLAIN, plain), (BY_QUOTES, quoted), (SPLIT_AT_CRLF, split)]
    kinds += [(WHOLE_CRLF, whole_crlf), (WHOLE, whole)]
    found = [(options, sorted(files)) for options, files in kinds if files]
    return found, rows, {file: row.header for file, row in first.items()}


def read_questions(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """Read a CSV file, a directory or a list of them; every column is a string.

    With ``multi_line=None`` the files are checked first, see ``line_options``. True
    reads each file whole, in one task; False splits files at every line end, which
    is wrong if a value holds one. All files must have the same header.

    Files of several kinds are read apart and put together, and large files with line ends in
    their values are read by quotes; the frame then carries ``_metadata`` as a column, which
    ``with_row_index`` takes and removes.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if any(p.lower().endswith(".xlsx") for p in paths):
        raise ValueError("spreadsheets cannot be read; save the sheet as CSV")

    if multi_line is not None:
        return _scan(spark, paths, {"multiLine": multi_line})
    kinds, rows, _ = _kinds(spark, paths)
    if len(kinds) <= 1 and rows is None:
        return _scan(spark, paths, kinds[0][0] if kinds else PLAIN)
    frames = [_placed(spark, files, lines, rows) for lines, files in kinds]
    if len({tuple(frame.columns) for frame in frames}) > 1:
        raise ValueError(f"files have different headers: {[frame.columns for frame in frames]}")
    return reduce(DataFrame.union, frames)


def _scan(spark: SparkSession, paths: Sequence[str], lines: dict) -> DataFrame:
    options = {"header": True, "enforceSchema": False, **QUOTING, **lines}
    return spark.read.options(**options).csv(list(paths))


def _placed(
    spark: SparkSession, files: Sequence[str], lines: dict, rows: DataFrame | None
) -> DataFrame:
    """Files of one kind and header, with ``_metadata`` as a column."""
    if lines is BY_QUOTES:
        return read_quoted(spark, rows, QUOTING)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    scan = _scan(pinned(spark), list(map(_pattern, files)), lines)
    return rehomed(spark, scan.select("*", place.alias("_metadata")))


def _header_groups(files: Sequence[str], headers: dict[str, str]) -> list[list[str]]:
    """Files that start with the same line; one whose header goes on behind it stands alone."""
    groups: dict[str, list[str]] = {}
    for file in files:
        header = (headers.get(file) or "").removeprefix("\ufeff")
        whole = re.match(WHOLE_ROW.replace(r"\z", r"\Z"), header)
        groups.setdefault(header if whole else file, []).append(file)
    return list(groups.values())


def read_question_sets(
    spark: SparkSession,
    path: str | Sequence[str],
    candidates: Sequence[str] = QUESTION_COLUMNS,
    normalize: bool = False,
) -> DataFrame:
    """Read CSV files that may have different headers, each by its own question column.

    Files with the same header are read together, as `read_questions` does, the accepted
    column is named ``question`` in each such group as `resolve_question` does, and the groups are
    united by name: a column that a file lacks is null for its rows. Names that differ in letter
    case alone are the same column. A group without a question column is an error that names
    one of its files.

    The headers come with the scan that tells the kinds of files, so nothing is read for
    them; every file is then read once, in one frame per header. ``with_row_index`` numbers the
    rows by file path, whatever group a file is in.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if any(p.lower().endswith(".xlsx") for p in paths):
        raise ValueError("spreadsheets cannot be read; save the sheet as CSV")
    kinds, rows, headers = _kinds(spark, paths)
    grouped = [(lines, _header_groups(files, headers)) for lines, files in kinds]
    if len(grouped) <= 1 and rows is None and sum(len(groups) for _, groups in grouped) <= 1:
        frame = _scan(spark, paths, grouped[0][0] if grouped else PLAIN)
        return resolve_question(frame, candidates, normalize)
    frames = []
    for lines, groups in grouped:
        for files in groups:
            own = rows
            if lines is BY_QUOTES and len(groups) > 1:
                own = quoted_rows(spark, list(map(_pattern, files)))
            frame = _placed(spark, files, lines, own)
            try:
                frames.append(resolve_question(frame, candidates, normalize))
            except QuestionColumnError as error:
                raise QuestionColumnError(f"{error} in {files[0]}") from None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def resolve_question(
    df: DataFrame, candidates: Sequence[str] = QUESTION_COLUMNS, normalize: bool = False
) -> DataFrame:
    """Name the first accepted column ``question``; other columns stay.

    Names are compared as they are. ``normalize=True`` also accepts names that
    differ in letter case or in spaces around them.
    """
    names = df.columns
    keys = [name.strip().lower() if normalize else name for name in names]
    chosen = next((c for c in candidates if c in keys), None)
    if chosen is None or keys.count(chosen) > 1:
        raise QuestionColumnError(
            f"{NO_QUESTION_COLUMN}: expected one of {list(candidates)}, found {names}"
        )
    at = keys.index(chosen)
    # Spark ignores letter case when it looks a column up, so a second column that
    # would answer to `question` has to give way.
    return df.toDF(
        *[
            "question" if i == at else f"{name}_" if name.lower() == "question" else name
            for i, name in enumerate(names)
        ]
    )

from qarun.sources.logs import damaged, intact, read_log, with_run, write_log
from qarun.sources.questions import (
    QuestionColumnError,
    read_question_sets,
    read_questions,
    resolve_question,
)
from qarun.sources.rolling import write_rolling_log

__all__ = [
    "QuestionColumnError",
    "damaged",
    "intact",
    "read_log",
    "read_question_sets",
    "read_questions",
    "resolve_question",
    "with_run",
    "write_log",
    "write_rolling_log",
]

from qarun.operators.asking import ask, with_session
from qarun.operators.timing import gaps, stalled
from qarun.operators.index import with_row_index
from qarun.operators.pairs import pair_turns
from qarun.operators.records import to_record
from qarun.operators.reports import (
    empty_responses,
    errors,
    shared_sessions,
    summary,
    unanswered,
    view,
)

__all__ = [
    "ask",
    "empty_responses",
    "errors",
    "gaps",
    "pair_turns",
    "shared_sessions",
    "stalled",
    "summary",
    "to_record",
    "unanswered",
    "view",
    "with_row_index",
    "with_session",
]

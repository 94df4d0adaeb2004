from qarun.streaming.counts import progress, progress_counts, read_log_stream
from qarun.streaming.late import late_questions
from qarun.streaming.shared import shared_sessions_live
from qarun.streaming.stalls import silent_runs, stalls
from qarun.streaming.tail import tail_log

__all__ = [
    "late_questions",
    "progress",
    "progress_counts",
    "read_log_stream",
    "shared_sessions_live",
    "silent_runs",
    "stalls",
    "tail_log",
]

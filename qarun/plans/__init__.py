from qarun.plans.recorded import recorded_results
from qarun.plans.runs import Review, prepare, review, run

__all__ = ["Review", "prepare", "recorded_results", "review", "run"]

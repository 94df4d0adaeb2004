"""A result table from stored conversations instead of a live bot."""

from pyspark.sql import DataFrame

from qarun.functions import ORDER_BUCKET_BITS
from qarun.operators import pair_turns, with_row_index


def recorded_results(conversations: DataFrame, bits: int = ORDER_BUCKET_BITS) -> DataFrame:
    """Every user turn as a numbered result, in order of ``conv_id, turn``.

    Pairing and numbering share one shuffle of the conversations.
    """
    pairs = pair_turns(conversations, keep_block=True, bits=bits)
    return with_row_index(pairs, ["conv_id", "turn"], bucket=["conv_id", "block"]).select(
        "row_index", "conv_id", "turn", "status", "phase", "question", "response"
    )

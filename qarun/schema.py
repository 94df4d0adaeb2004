"""The result record and the fixed words used in it."""

from pyspark.sql import types as T

# Column names accepted for the question, in order of precedence.
QUESTION_COLUMNS = ("question", "questions", "q")

# Fixed value: the start of the message when no such column is found.
NO_QUESTION_COLUMN = "Could not find a question column"

# The six fields of a result record, in order.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)
RECORD_FIELDS = tuple(RECORD_SCHEMA.names)

# Fixed values: `status` and `phase` words.
OK, ERROR = "ok", "error"
ASK, START_SESSION = "ask", "start_session"

# Column that receives log lines which are not whole JSON objects.
CORRUPT = "_corrupt"

# Column that names the fields of a log line whose values could not be read.
DAMAGED = "_damaged"

"""Column types of the SQL dialect."""

from __future__ import annotations

from pyspark.sql import types as T

# Type words of the dialect and what they store. Any other word is text.
WORDS = {
    "INT": T.LongType(), "INT4": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "SMALLINT": T.LongType(), "SERIAL": T.LongType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "FLOAT": T.DoubleType(), "FLOAT8": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(),
    "BYTEA": T.BinaryType(),
}


def spark_type(word: str) -> T.DataType:
    """The Spark type of a type word; VARCHAR, DECIMAL, DATE, JSON and the like are text.

    >>> spark_type("smallint"), spark_type("VARCHAR(20)")
    (LongType(), StringType())
    """
    return WORDS.get(word.strip().upper(), T.StringType())


def identifier(text: str) -> str:
    """A name without quote marks, in lower case."""
    return text.strip().strip('`"[]').lower()

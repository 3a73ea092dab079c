"""Column functions for pipelines of whole numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_int32(x: Column) -> Column:
    """A whole number as a 32-bit one that wraps round, where plain arithmetic would raise."""
    return ((F.pmod(x.cast("long") + F.lit(1 << 31), F.lit(1 << 32))) - F.lit(1 << 31)).cast("int")


def parsed(line: Column, kind: str) -> Column:
    """A trimmed line as a value of the type; a bad line raises. `char` takes the one character."""
    text = F.trim(line)
    if kind == "char":
        return F.when(F.length(text) == 1, text).otherwise(F.raise_error(F.concat(F.lit("not one character: "), text)))
    return text.cast(kind)


def without_nulls(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def code_sum(text: Column) -> Column:
    """Sum of the character codes of a text."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1)))), F.lit(0), lambda a, b: a + b)

"""A name for an expression inside other expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once per row, however often, or in whatever lambda, `body` uses it.

    A plain column used in a lambda is computed, or its bytes copied out of the row, on every step.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

"""Scalar cleaning expressions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_codes(*codes: Column | str) -> Column:
    """All codes that are not null, one after the other; null if there is none."""
    return F.nullif(F.concat_ws("", *map(_col, codes)), F.lit(""))


def first_known(*columns: Column | str) -> Column:
    return F.coalesce(*map(_col, columns))


def device_kind(code1, code2, code3) -> Column:
    """1 if the first or second code is known, 2 if only the third is, else -1."""
    known = _col(code1).isNotNull() | _col(code2).isNotNull()
    return F.when(known, 1).when(_col(code3).isNotNull(), 2).otherwise(-1)


def last_match(text, classes: Mapping[str, Sequence[str]], unknown: str = "-1", other: str = "others") -> Column:
    """The class of the last dictionary entry that occurs in the text, in the
    order of ``classes``; ``unknown`` for null (or 'nan'), ``other`` for no match."""
    text = _col(text)
    found = F.when(text.isNull() | (text == "nan"), unknown)
    for name, entries in reversed(classes.items()):
        found = found.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in entries)), name)
    return found.otherwise(other)


def equals_flag(column, value) -> Column:
    """1 if equal, 0 if not, -1 if null."""
    return F.when(_col(column).isNull(), -1).when(_col(column) == value, 1).otherwise(0)


def pair_presence(first, second) -> Column:
    """3 both known, 2 only the first, 1 only the second, -1 neither."""
    a, b = _col(first).isNotNull(), _col(second).isNotNull()
    return F.when(a & b, 3).when(a, 2).when(b, 1).otherwise(-1)


def null_flag(column) -> Column:
    return _col(column).isNull().cast("int")


def null_count(*columns) -> Column:
    return reduce(add, map(null_flag, columns))


def presence_label(column, present: str, absent: str) -> Column:
    return F.when(_col(column).isNotNull(), present).otherwise(absent)


def positive_part(column) -> Column:
    return F.greatest(_col(column), F.lit(0))


def negative_part(column) -> Column:
    return F.least(_col(column), F.lit(0))


def guarded_ratio(a, b, guard: float = 0.01) -> Column:
    return _col(a) / (F.lit(guard) + _col(b))


def ratio(a, b) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(_col(a), _col(b))


def text_token(column, missing: str = "nan") -> Column:
    """The value as text, with a word of its own for null."""
    return F.coalesce(_col(column).cast("string"), F.lit(missing))


def replaced_where(condition: Column, value, column) -> Column:
    """The column with ``value`` where the condition holds."""
    return F.when(condition, value).otherwise(_col(column))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return reduce(add, (F.lit(w) * F.col(c) for c, w in weights.items()))


def filled(df: DataFrame, text: str = "-1", number: int = -1) -> DataFrame:
    """Nulls of text columns become ``text``, those of numeric ones ``number``."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.fillna(text, texts).fillna(number, numbers)

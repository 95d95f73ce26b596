"""Optional filters, string conditions, boundaries and paging for listings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """Conjunction; None is no constraint."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions, F.lit(False))


def equals(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == value


def one_of(column: str, values: Iterable | None) -> Column | None:
    """None or an empty list: no constraint. Members that aren't numbers are skipped; if none is left, no row fits."""
    values = list(values or ())
    numbers = [v for v in values if isinstance(v, int | float) or str(v).lstrip("-").isdigit()]
    return None if not values else F.col(column).isin([int(v) for v in numbers]) if numbers else F.lit(False)


def signed_class(column: str, value: int | None) -> Column | None:
    """Positive: equal; negative: all but its absolute value; None or 0: no constraint."""
    return None if not value else F.col(column) == value if value > 0 else F.col(column) != -value


def text_match(column: str, term: str | None, where: str = "infix") -> Column | None:
    """Prefix, suffix or infix, in any case, with blanks and underscores alike."""
    if term is None:
        return None
    folded = F.upper(F.replace(F.col(column), F.lit(" "), F.lit("_")))
    wanted = F.upper(F.lit(term.replace(" ", "_")))
    return {"prefix": folded.startswith, "suffix": folded.endswith, "infix": folded.contains}[where](wanted)


def boundary(column: str, value: object | None, ascending: bool = True, inclusive: bool = False) -> Column | None:
    """Rows behind a key of the listing."""
    if value is None:
        return None
    c = F.col(column)
    return (c >= value if inclusive else c > value) if ascending else (c <= value if inclusive else c < value)


def page_of(df: DataFrame, order: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """A page of a listing; `order` must be total. A negative limit is none."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit >= 0 else out

"""Column-level helpers (PRJ1–PRJ3, PRJ6–PRJ12, FLT5–FLT7).

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order states of the ERP export and the rating they stand for.
STATE_RATINGS = {"Sales Order": 4.0, "Done": 5.0}


def composite_key(a: str, b: str) -> Column:
    """PRJ1: ``"a:b"`` (export only; joins use the two columns)."""
    return F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))


def pair_id(a: str, b: str) -> tuple[Column, Column]:
    """PRJ2: canonical unordered pair (smaller, larger)."""
    return F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))


def scaled(c: str, weight: float) -> Column:
    """PRJ3: ``c · weight``."""
    return F.col(c) * F.lit(weight)


def as_string_id(c: str) -> Column:
    """PRJ6."""
    return F.col(c).cast("string")


def state_to_rating(c: str) -> Column:
    """PRJ7: ``Sales Order`` → 4, ``Done`` → 5, anything else → null
    (the caller sends null-rated rows to the quarantine)."""
    expr = None
    for state, rating in STATE_RATINGS.items():
        expr = (F.when(F.col(c) == state, F.lit(rating)) if expr is None
                else expr.when(F.col(c) == state, F.lit(rating)))
    return expr


def id_after_last(c: str, sep: str = "_") -> Column:
    """PRJ8: the numeric id after the last ``sep``, quotes stripped; null if
    that is no number."""
    s = F.regexp_replace(F.col(c), '"', "")
    return F.substring_index(s, sep, -1).try_cast("int")


def safe_feature_name(c: str) -> Column:
    """PRJ9: lower case, letters only."""
    return F.regexp_replace(F.lower(F.col(c)), "[^a-z]", "")


def category_feature_name(c: str, prefix: str = "f") -> Column:
    """PRJ10."""
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def half_stars_to_ten(c: str) -> Column:
    """PRJ11: 0.5 … 5.0 → 1 … 10."""
    return (F.col(c) * 2).cast("int")


def parse_id_list(c: str) -> Column:
    """PRJ12: ``"1:2:3"`` → ``[1, 2, 3]``; the empty string → ``[]``;
    parts that are no number are left out."""
    parts = F.filter(F.split(F.col(c), ":"), lambda x: F.length(x) > 0)
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def join_id_list(c: str) -> Column:
    """Inverse of PRJ12 (the stored text form)."""
    return F.concat_ws(":", F.transform(F.col(c), lambda x: x.cast("string")))


def usable_prediction(c: str = "prediction") -> Column:
    """FLT5: neither null nor NaN (NaN would sort first descending)."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def non_empty(*cols: str) -> Column:
    """FLT7: every column present and non-empty."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0)
    return cond


def dot(a: str, b: str, d: int | None = None) -> Column:
    """Dot product of two equally long numeric arrays (as double).

    With the length ``d`` known at plan time (ALS rank, number of declared
    features) the product is unrolled into plain arithmetic, which stays in
    whole-stage codegen; the lambda form is the fallback for unknown d.
    """
    if d is not None:
        terms = [F.col(a)[j].cast("double") * F.col(b)[j].cast("double") for j in range(d)]
        out = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            out = out + t
        return out
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)

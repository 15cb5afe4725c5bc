"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """numerator / denominator in double, ``default`` where the denominator is zero or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(default))


def spearman_pvalue(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation: Student t with n-2 degrees of freedom.

    For whole degrees of freedom the t distribution is a finite trigonometric series in
    theta = atan(t / sqrt(dof)); fewer than three points have no p value.
    """
    dof = (n - 2).cast("int")
    sin = F.abs(rho)
    cos2 = F.greatest(F.lit(0.0), 1.0 - rho * rho)
    cos = F.sqrt(cos2)
    theta = F.atan2(sin, cos)

    def series(first: Column, start: Column, terms: Column) -> Column:
        # sum of first * prod(cos2 * (start + 2i - 1) / (start + 2i)), i = 1..terms
        state = F.aggregate(
            F.sequence(F.lit(1), F.greatest(terms, F.lit(1))),
            F.struct(first.alias("term"), first.alias("total")),
            lambda acc, i: F.struct(
                F.when(i <= terms, acc["term"] * cos2 * (start + 2 * i - 1) / (start + 2 * i))
                .otherwise(F.lit(0.0))
                .alias("term"),
                (
                    acc["total"]
                    + F.when(i <= terms, acc["term"] * cos2 * (start + 2 * i - 1) / (start + 2 * i)).otherwise(
                        F.lit(0.0)
                    )
                ).alias("total"),
            ),
        )
        return state["total"]

    odd_terms = F.when(dof >= 3, ((dof - 3) / 2).cast("int")).otherwise(F.lit(0))
    odd = (2.0 / math.pi) * (
        theta + F.when(dof > 1, sin * series(cos, F.lit(1.0), odd_terms)).otherwise(F.lit(0.0))
    )
    even_terms = F.when(dof >= 2, ((dof - 2) / 2).cast("int")).otherwise(F.lit(0))
    even = sin * series(F.lit(1.0), F.lit(0.0), even_terms)
    inside = F.when(dof % 2 == 1, odd).otherwise(even)
    return F.when((n > 2) & rho.isNotNull(), F.greatest(F.lit(0.0), 1.0 - inside))

"""Statistics as column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
Z95_EXACT = 1.959963984540054


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval of a share p of n, cut to [0, 1]; n must be positive."""
    n = n.cast("double")
    below = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / below
    margin = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / below
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(empty)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_factorials(n: Column) -> Column:
    """ln(n!) as a running sum of logarithms."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs; 1 without any.

    Each sum is a lambda's variable where another uses it: named in a lambda's body it would be
    summed again for every term.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def p(g: Column) -> Column:
        n, k = g["n"], g["k"]
        # ln C(n, k)
        last = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: F.when(i <= k, s + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).otherwise(s))
        # the tail in the scale of its largest term, C(n, k), from that down: C(n, i - 1) is C(n, i) i / (n - i + 1)
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        less = lambda s, i: s["term"] * i.cast("double") / (n - i + 1).cast("double")
        step = lambda s, i: F.when(i < 1, s).otherwise(F.struct(less(s, i).alias("term"), (s["sum"] + less(s, i)).alias("sum")))
        tail = F.aggregate(F.sequence(k, F.lit(0), F.lit(-1)), start, step, lambda s: s["sum"])
        return F.when(n > 0, F.least(F.lit(1.0), F.exp(last - n * F.log(F.lit(2.0)) + F.log(F.lit(2.0))) * tail)).otherwise(1.0)

    return let(F.struct((b + c).cast("int").alias("n"), F.least(b, c).cast("int").alias("k")), p)


def cohen_kappa(both: Column, only_a: Column, only_b: Column, none: Column) -> Column:
    """From counts of agreement on yes, disagreements and agreement on no; null where chance agreement is 1."""
    n = (both + only_a + only_b + none).cast("double")
    seen = (both + none) / n
    chance = ((both + only_a) * (both + only_b) + (none + only_a) * (none + only_b)) / (n * n)
    return F.when(chance != 1.0, (seen - chance) / (1.0 - chance))

"""Column expressions over counts and strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import binom_tail

NAN = float("nan")


def density(m: Column, total: Column) -> Column:
    """Methylated share; NaN where nothing covers the cytosine."""
    return F.when(total == 0, F.lit(NAN)).otherwise(m.cast("double") / F.nullif(total, F.lit(0)))


def covered(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def strand_fits(region: Column, own: Column) -> Column:
    """A region without strand takes both."""
    return (region == ".") | (region == own)


def binom_sf(m: Column, n: Column, p: Column) -> Column:
    """P(X >= m) for X ~ Binomial(n, p) in Arrow batches, at a cost that hardly grows with n. 1 at m = 0."""
    return binom_tail(m, n, p)


def complement(c: Column) -> Column:
    """Complement of upper-case bases with the fixed ambiguity codes; M has no complement and goes."""
    return F.translate(c, "ATGCURYKBDHVNM", "TACGRUKYNNNNN")


def trinucleotide_context(t: Column, forward: bool) -> Column:
    """CG, CHG or CHH of a trinucleotide read forward from its C, or of the reverse strand's triplet ending in it."""
    if forward:
        return F.when(F.substring(t, 2, 1) == "G", "CG").when(F.substring(t, 3, 1) == "G", "CHG").otherwise("CHH")
    return F.when(F.substring(t, 2, 1) == "C", "CG").when(F.substring(t, 1, 1) == "C", "CHG").otherwise("CHH")

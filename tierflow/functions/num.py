"""Rounding that agrees across engines."""

from pyspark.sql import Column, functions as F


def rnd(c, digits: int = 6) -> Column:
    """Nearest multiple of 10^-digits, from the binary value. The built-in ``round`` goes
    through the shortest decimal form, which turns 4.725 into 4.73."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c.cast("double") * scale + 0.5) / F.lit(scale)


def let(c: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    A column that an expression names many times is copied into every place, and nested uses multiply the copies.
    """
    return F.transform(F.array(c), body)[0]


def even(c, digits: int) -> Column:
    """Nearest multiple of 10^-digits, exact ties to the even one, as Python's ``round``.

    The product c * 10^digits is rounded itself; where it looks like a tie, the part that the multiplication lost (both factors
    split so that partial products are exact) tells on which side of it the true value lies.
    """
    scale = float(10 ** digits)

    def body(c: Column) -> Column:
        product = c * scale
        high = c * 134217729.0 - (c * 134217729.0 - c)
        lost = (high * scale - product) + (c - high) * scale
        tie = product - F.floor(product) == 0.5
        return F.when(tie & (lost > 0), F.floor(product) + 1.0).when(tie & (lost < 0), F.floor(product).cast("double")).otherwise(
            F.rint(product)) / F.lit(scale)

    return let((F.col(c) if isinstance(c, str) else c).cast("double"), body)

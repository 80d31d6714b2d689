"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role bitmask (fixed values).
ROLE_CUSTOMER = 1
ROLE_VENDOR = 2
ROLE_ADMIN = 4

# Product status vocabulary (fixed values).
ACTIVE, INACTIVE, OUT_OF_STOCK = "Active", "Inactive", "OutOfStock"


def clean_terms(terms: Iterable[str | None] | None, lower: bool = True) -> list[str]:
    """Strip, drop empty, optionally lower-case, de-duplicate keeping order."""
    out: list[str] = []
    for t in terms or []:
        if t is None:
            continue
        t = t.strip()
        if lower:
            t = t.lower()
        if t and t not in out:
            out.append(t)
    return out


def ci_contains(col: Column | str, term: str) -> Column:
    """Case-free literal substring test: ``%`` and ``_`` are plain text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c).contains(term.lower())


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def money(col: Column | str) -> Column:
    """DECIMAL money to DOUBLE, only at the output edge."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")


def round2(col: Column) -> Column:
    """Half-up rounding to two places, the same in every SQL engine."""
    return F.floor(col * 100 + 0.5) / 100


def price_text(col: Column | str) -> Column:
    """``$1234.50`` from a DECIMAL(10,2) price."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit("$"), c.cast("decimal(10,2)").cast("string"))


def has_role(bits: Column | str, flag: int) -> Column:
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(flag)) != 0


def trigger_status(old_stock, new_stock, status):
    """The stock trigger, as a pure rule after any product update: stock 0 is
    OutOfStock unless Inactive; stock back from 0 makes OutOfStock Active."""
    return (F.when((new_stock == 0) & (status != INACTIVE), F.lit(OUT_OF_STOCK))
            .when((new_stock > 0) & (old_stock == 0) & (status == OUT_OF_STOCK), F.lit(ACTIVE))
            .otherwise(status))


def date_time(col):
    """Output form of a timestamp, to the second."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")

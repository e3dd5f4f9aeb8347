"""Money in integer minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naira_to_kobo(c: Column) -> Column:
    """Decimal text with at most two places, commas allowed, to minor units; anything else is null, as is what 64 bits cannot hold."""
    bare = F.replace(F.trim(c), F.lit(","), F.lit(""))
    ok = bare.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$")
    return F.when(ok, (bare.try_cast("decimal(21,2)") * 100).try_cast("long"))


def apply_bp(amount: Column, bp: Column) -> Column:
    """Basis points of a non-negative amount, halves up."""
    return F.floor((amount * bp + 5000).cast("decimal(38,0)") / 10000).cast("long")


def format_naira(kobo: Column) -> Column:
    """1234567 as 12,345.67."""
    return F.format_number((kobo.cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2)


def whole_kobo(amount: Column) -> Column:
    """A connector's number as minor units; null where it is no whole number or beyond 2^53, where a float may have lost units."""
    return F.when((amount == F.floor(amount)) & (F.abs(amount) <= 2**53 - 1), amount.cast("long"))

"""Column functions on dates, vectors, chunks' metadata and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_gap(a: Column, b: Column) -> Column:
    """Calendar months between two dates, whatever their days."""
    return F.abs((F.year(a) * 12 + F.month(a)) - (F.year(b) * 12 + F.month(b)))


def publication_date(text: Column, year: Column) -> Column:
    """A date as yyyy-MM-dd, else the first of January of a year, else null."""
    strict = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d"))
    return F.coalesce(strict, F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for empty vectors, unequal lengths and vectors of no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fine & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def similarity(distance: Column) -> Column:
    return F.round(1 - distance, 4)


def rounded(x: Column, places: int) -> Column:
    """A double, rounded half away from 0; what is below 0 rounds to -0.0, where ``F.round`` gives 0.0."""
    return F.round(F.abs(x), places) * F.signum(x)


def present(keys: list[str], values: list[Column]) -> Column:
    """Map of the entries that are not null."""
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[v.cast("string") for v in values]))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def ids_of(records: Column, name: str = "paperId") -> Column:
    """Non-empty ids of a list of records, in order; null records are passed over."""
    found = F.transform(records, lambda r: r[name])
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def block_text(block: Column) -> Column:
    """Text of an extracted block: its content list joined by lines, or its content."""
    return F.trim(F.array_join(block, "\n"))

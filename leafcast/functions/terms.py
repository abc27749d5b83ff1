"""Embedded taxonomy terms as ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS_T = "array<array<struct<taxonomy:string,name:string>>>"


def _flat_terms(embedded: Column) -> Column:
    flat = F.flatten(F.coalesce(embedded, F.array().cast("array<array<struct<taxonomy:string,name:string>>>")))
    return F.filter(flat, lambda t: (F.coalesce(t["taxonomy"], F.lit("")) != "") & t["name"].isNotNull())


def terms_by_taxonomy(embedded: Column) -> Column:
    """array<struct<taxonomy, names>>, taxonomies in first-seen order, names in order."""
    flat = _flat_terms(embedded)
    taxes = F.array_distinct(F.transform(flat, lambda t: t["taxonomy"]))
    return F.transform(
        taxes,
        lambda x: F.struct(
            x.alias("taxonomy"),
            F.transform(F.filter(flat, lambda t: t["taxonomy"] == x), lambda t: t["name"]).alias("names"),
        ),
    )


def terms_flat(embedded: Column) -> Column:
    """Every term name, grouped by taxonomy as in G4, in one list."""
    return F.flatten(F.transform(terms_by_taxonomy(embedded), lambda g: g["names"]))


def term_count(embedded: Column) -> Column:
    """Number of embedded term records (0 for a post without terms), whatever the ANSI mode."""
    return F.aggregate(F.coalesce(embedded, F.array().cast(TERMS_T)), F.lit(0),
                       lambda acc, g: acc + F.coalesce(F.size(F.coalesce(g, F.array().cast(TERMS_T.split("<", 1)[1][:-1]))), F.lit(0)))

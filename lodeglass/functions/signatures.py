"""Signature shapes and similarity scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"name": 0.50, "shape": 0.25, "kind": 0.10, "neighborhood": 0.15}


def arity(signature: Column) -> Column:
    """Parameters in the first balanced parentheses: commas at their top level plus one, 0 if blank, null without such.

    Brackets `([{<` nest. The `>` of an arrow inside the list closes a level too, as in the scores this has to agree with.
    """
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"), F.lit(False).alias("some"), F.lit(False).alias("done"))

    def step(acc, c):
        inside = (acc["depth"] > 0) & ~acc["done"]
        opens = c.isin("(", "[", "{", "<") & inside | (c == "(") & ~acc["done"]
        closes = c.isin(")", "]", "}", ">") & inside
        depth = acc["depth"] + opens.cast("int") - closes.cast("int")
        ends = closes & (depth == 0)
        return F.struct(
            depth.alias("depth"), (acc["commas"] + (inside & (c == ",") & (acc["depth"] == 1)).cast("int")).alias("commas"),
            (acc["some"] | (inside & ~ends & ~c.rlike(r"\s"))).alias("some"), (acc["done"] | ends).alias("done"),
        )

    return F.when(F.length(signature) > 0, F.aggregate(F.split(signature, ""), begin, step, lambda acc: F.when(acc["done"], F.when(acc["some"], acc["commas"] + 1).otherwise(0))))


def return_type(signature: Column) -> Column:
    """What follows the last `->`, else the `:` after the last `)`, without a closing `{`, white space made single; null if nothing does."""
    arrow = F.regexp_extract(signature, r"(?s)^.*->(.*)$", 1)
    colon = F.regexp_extract(signature, r"(?s)^.*\)[^:)]*:(.*)$", 1)
    raw = F.when(signature.contains("->"), arrow).otherwise(colon)
    clean = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\{\s*$", ""), r"\s+", " "))
    return F.when(clean != "", clean)


def shape_key(signature: Column) -> Column:
    """`arity=N|ret=T` with `?` for what is unknown, parts joined by `;`."""
    return F.concat(F.lit("arity="), F.coalesce(arity(signature).cast("string"), F.lit("?")), F.lit(";ret="), F.coalesce(return_type(signature), F.lit("?")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def shape_score(arity_a: Column, ret_a: Column, arity_b: Column, ret_b: Column) -> Column:
    """Half for the arity (1 equal, 0.5 off by one), half for the return type (equal, or absent in both)."""
    by_arity = F.coalesce(F.when(arity_a == arity_b, 1.0).when(F.abs(arity_a - arity_b) == 1, 0.5), F.lit(0.0))
    by_return = F.coalesce(F.when(ret_a.eqNullSafe(ret_b), 1.0), F.lit(0.0))
    return (by_arity + by_return) / 2


def blend(name: Column, shape: Column, kind: Column, neighborhood: Column) -> Column:
    """The weighted score; without a neighbourhood (null) the other weights fill its part."""
    own = WEIGHTS["name"] * name + WEIGHTS["shape"] * shape + WEIGHTS["kind"] * kind
    return F.when(neighborhood.isNull(), own / (1 - WEIGHTS["neighborhood"])).otherwise(own + WEIGHTS["neighborhood"] * neighborhood)

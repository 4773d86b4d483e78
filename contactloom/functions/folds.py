"""Ordered folds over arrays: rows of one key become one, at the place of the first.

The order of the elements matters in every rule here, so none of them is an aggregate:
keys keep first-seen order, and each fold sees its elements in input order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.dims import SOURCE_PRIORITY
from contactloom.functions.text import constants, let


def fold_by(values: Column, key: Callable[[Column], Column], step: Callable[[Column, Column], Column]) -> Column:
    """For each key in first-seen order: its first element, changed by ``step(kept, next)``.

    Elements are sorted by key and place, so that each key's are neighbours and the work grows with n log n.
    """

    def folded(own: Column) -> Column:
        rest = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
        return F.struct(own[0]["at"].alias("at"), F.aggregate(rest, own[0]["v"], lambda kept, x: step(kept, x["v"])).alias("v"))

    def of_sorted(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda _, k: k), lambda k: (k == 0) | (s[k]["k"] != s[F.greatest(k - 1, F.lit(0))]["k"]))
        runs = let(begins, lambda b: F.transform(b, lambda k, j: folded(F.slice(s, k + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - k))))
        return F.transform(F.sort_array(runs), lambda x: x["v"])

    def of(own: Column) -> Column:
        keyed = F.transform(own, lambda x, k: F.struct(F.coalesce(key(x), F.lit("")).alias("k"), k.alias("at"), x.alias("v")))
        # most lists have no two elements
        return F.when(F.size(own) <= 1, own).otherwise(let(F.sort_array(keyed), of_sorted))

    return let(values, of)


def distinct_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """First wins."""
    return fold_by(values, key, lambda kept, _: kept)


def priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(constants(SOURCE_PRIORITY), F.coalesce(source, F.lit(""))), F.lit(0))


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def stronger_or_fuller(kept: Column, new: Column) -> Column:
    """The next one replaces the kept one if its source is stronger, or if only it has a context; even if it is weaker."""
    return F.when((priority(new["source"]) > priority(kept["source"])) | _empty(kept["context"]) & ~_empty(new["context"]), new).otherwise(kept)


def backfilled(kept: Column, new: Column) -> Column:
    """The number of the stronger source wins, as it was written, and its context or source, if it lacks one, is the other's."""
    better = priority(new["source"]) > priority(kept["source"])
    own, other = F.when(better, new).otherwise(kept), F.when(better, kept).otherwise(new)
    filled = lambda f: F.when(_empty(own[f]) & ~_empty(other[f]), other[f]).otherwise(own[f])
    return own.withField("context", filled("context")).withField("source", filled("source"))


def specific_platform(kept: Column, new: Column) -> Column:
    """A named platform takes the place of ``other``."""
    return F.when((kept["platform"] == "other") & (new["platform"] != "other"), kept.withField("platform", new["platform"])).otherwise(kept)


def nonempty_text(kept: Column, new: Column) -> Column:
    """A later link with a text takes the place of one without."""
    return F.when(_empty(kept["text"]) & ~_empty(new["text"]), new).otherwise(kept)


def without(values: Column, others: Column, key: Callable[[Column], Column], other_key: Callable[[Column], Column]) -> Column:
    """Elements whose key none of the others has."""
    return F.filter(values, lambda x: ~F.exists(others, lambda o: other_key(o) == key(x)))

"""Operators over key columns, each a composition of joins, windows and aggregates.

Each takes DataFrames and column names, so that shredded lexicons and adapted tables use the same plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, scope: list[str], key: str, order: list[str], label: str) -> DataFrame:
    """Rows whose key came before in their scope, with the first holder's label as ``first_label``.

    Keys are counted before they are windowed, so that unique keys are not sorted.
    """
    by = [*scope, key]
    again = rows.where(F.col(key).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    w = Window.partitionBy(*by).orderBy(*order)
    some = rows.join(again, by).withColumn("__rn", F.row_number().over(w)).withColumn("first_label", F.first(label).over(w))
    return some.where("__rn > 1").drop("__rn")


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References that match no target; empty ones are not references."""
    keys = targets.where((F.col(target) != "") & F.col(target).isNotNull()).select(F.col(target).alias(ref)).distinct()
    return refs.where((F.col(ref) != "") & F.col(ref).isNotNull()).join(keys, ref, "left_anti")


def undefined_values(values: DataFrame, scope: str, value: str, allowed: DataFrame, allowed_value: str) -> DataFrame:
    """Values that their range does not list.  Ranges without elements vouch for nothing and reject nothing."""
    known = allowed.select(scope, F.col(allowed_value).alias("__v")).distinct()
    ranges = known.select(scope).distinct()
    v = values.where((F.col(value) != "") & F.col(value).isNotNull()).join(ranges, scope, "left_semi")
    return v.join(known, (v[scope] == known[scope]) & (v[value] == known["__v"]), "left_anti")


def missing_parents(rows: DataFrame, scope: list[str], key: str, parent: str) -> DataFrame:
    """Rows whose non-empty parent is no key of their scope."""
    keys = rows.select(*scope, F.col(key).alias(parent)).distinct()
    return rows.where((F.col(parent) != "") & F.col(parent).isNotNull()).join(keys, [*scope, parent], "left_anti")



def first_by_priority(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], buckets: int = 0) -> DataFrame:
    """Each left row with the last right row of its group at or before it: a union and one running window, no range join.

    Of right rows at one position the one with the largest ``columns`` holds.  With ``buckets`` positions are cut
    into that many equal ranges, so a group that holds a large share of all rows is not one task: the last right row
    of each range is carried on to the ranges after it, a table of at most one row per group and range.  Rows of ranges
    without right rows, such as all beyond the last, need no window and go to as many tasks as there are ranges.
    """
    cols = F.struct(F.col(at).alias("__at"), *columns)
    names = left.columns
    both = left.select(*[F.col(c) for c in names], F.lit(None).cast(_struct(right, at, columns)).alias("__r"), F.lit(1).alias("__left"))
    other = right.select(*[(F.col(c) if c in [*by, at] else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in names], cols.alias("__r"), F.lit(0).alias("__left"))
    rows, keys = both.unionByName(other), list(by)
    if buckets:
        span = right.select(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
        if span and span.lo is not None and span.hi > span.lo:
            step = (float(span.hi) - float(span.lo)) / buckets
            cut = F.least(F.greatest(F.floor((F.col(at) - F.lit(span.lo)) / F.lit(step)), F.lit(-1)), F.lit(buckets)).cast("int")
            rows, keys = rows.withColumn("__b", cut), [*by, "__b"]
            last = rows.where("__left = 0").groupBy(*keys).agg(F.max("__r").alias("__r"))
            w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
            ranges = rows.select(*keys).distinct().join(last, keys, "left").withColumn("__carry", F.last("__r", ignorenulls=True).over(w))
            ranges = ranges.select(*keys, "__carry", F.col("__r").isNull().alias("__none"))
            rows = rows.join(ranges if by else F.broadcast(ranges), keys)
            rows, keys = rows.withColumn("__s", F.when(F.col("__none"), F.pmod(F.xxhash64(at), F.lit(buckets))).otherwise(0)), [*keys, "__s"]
    w = Window.partitionBy(*keys).orderBy(at, "__left", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__r", ignorenulls=True).over(w)
    rows = rows.withColumn("__f", F.coalesce(found, F.col("__carry")) if "__carry" in rows.columns else found).where("__left = 1")
    return rows.select(*names, *[F.col(f"__f.{c}").alias(c) for c in columns])


def _struct(df: DataFrame, at: str, columns: list[str]) -> str:
    return df.select(F.struct(F.col(at).alias("__at"), *columns).alias("s")).schema["s"].dataType.simpleString()


def unreferenced(files: DataFrame, refs: DataFrame, candidates: Column, path: str) -> DataFrame:
    """Files that are no reference's candidate."""
    return files.join(refs.select(F.explode(candidates).alias(path)), path, "left_anti")


def anti_paths(refs: DataFrame, candidates: Column, files: DataFrame, path: str) -> DataFrame:
    """References none of whose candidate paths is a file.  ``refs`` needs a unique ``ref_id``."""
    found = refs.select("ref_id", F.explode(candidates).alias(path)).join(files.select(path).distinct(), path, "left_semi").select("ref_id").distinct()
    return refs.join(found, "ref_id", "left_anti")

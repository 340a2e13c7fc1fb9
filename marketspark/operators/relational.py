"""Relational operators: latest and top rows per key, comparisons, upserts, as-of and anti joins, feeds, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows for which every predicate that isn't None holds (dynamic filters)."""
    for p in predicates:
        if p is not None:
            df = df.where(p)
    return df


def contains(column: str, text: str) -> Column:
    """Case-insensitive substring test without wildcards."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """The row of greatest `order` for each key, ties by greatest `tie`. A struct maximum combines before the shuffle, so a
    hot key does not gather in one window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(order), F.col(tie), *[F.col(c) for c in rest if c not in (order, tie)])).alias("_")
    return df.groupBy(*keys).agg(best).select(*keys, "_.*").select(*df.columns)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1. Spark keeps n rows a key and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def page(df: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def merged_feed(parts: Sequence[DataFrame], order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows of several sources as one feed. Each source is cut to `limit` before they meet."""
    out = None
    for p in parts:
        p = p.orderBy(*order).limit(limit)
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*order).limit(limit)


def compare_keyed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side: shared, a_only or b_only. Keys are distinct on either side; null keys are left out."""
    a, b = a.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), b.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("_b").isNull(), "a_only").when(F.col("_a").isNull(), "b_only").otherwise("shared").alias("side"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and change (added, removed, modified) between two snapshots; equal rows are left out. Null fields are equal."""
    o = old.select(key, F.struct(*fields).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(key, F.struct(*fields).alias("_n"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def upsert_touch(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Rows of old keep their payload and take the greatest stamp; keys that are new bring the earliest new row."""
    both = old.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(2)))
    rest = [c for c in old.columns if c not in (*keys, stamp)]
    out = both.groupBy(*keys).agg(F.min(F.struct("_new", stamp, *rest)).alias("_r"), F.max(stamp).alias(stamp))
    return out.select(*keys, stamp, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*old.columns)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str, tie: str) -> DataFrame:
    """The latest row of each key over old and new; a tie goes to the greater `tie`."""
    return latest_per_key(old.unionByName(new), keys, stamp, tie)


def merge_maps(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Shallow merge of map columns by key: entries of new win."""
    o, n = old.select(key, F.col(column).alias("_o")), new.select(key, F.col(column).alias("_n"))
    empty = F.map_from_arrays(F.array(), F.array()).cast(old.schema[column].dataType)
    a, b = F.coalesce("_o", empty), F.coalesce("_n", empty)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return o.join(n, key, "full_outer").select(key, F.map_concat(kept, b).alias(column))


def asof_next(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str, out: str = "next_value") -> DataFrame:
    """left with the value of the first right row of the same key at or after `at` (null if none), ties by least value.

    One union, one sort within the key: no range join. left's own rows sort after right's at the same time, read backwards.
    """
    cols = left.columns
    a = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(key), F.col(right_at).alias("_t"), F.col(value).alias("_v"), F.lit(2).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.asc_nulls_last("_v")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.first(F.when(F.col("_side") == 2, F.col("_v")), ignorenulls=True).over(w))
    return both.where("_side = 1").select(*cols, out)


def dedup_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return top_n_per_key(df, keys, order, 1, "_r").drop("_r")


def concat_any(*parts: DataFrame) -> DataFrame:
    """Union by name; a column that a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of child whose key no parent has (null keys pass, as foreign keys do)."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def without_parent(children: dict[str, DataFrame], fk: str, ids: Sequence[int]) -> dict[str, DataFrame]:
    """Cascade delete: every child table without the rows of the parents named."""
    return {name: df.where(F.col(fk).isNull() | ~F.col(fk).isin(list(ids))) for name, df in children.items()}

"""Config files in, tables and exports out. Paths go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "competitors array<struct<name:string, website_url:string, enabled:boolean, collection_frequency:string, tags:array<string>>>"


def config(spark: SparkSession, path: str) -> DataFrame:
    """A row a competitor of a JSON config file with a declared schema."""
    return spark.read.schema(CONFIG).json(path, multiLine=True).select(F.explode("competitors").alias("c")).select("c.*")


def sync(dim: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """dim after a config: new keys in, changed rows updated, missing ones disabled, the rest kept; column `action` says which.
    Columns of both are dim's; a null `enabled` counts as true."""
    cols = [c for c in dim.columns if c != key]
    a = dim.select(key, F.struct(*cols).alias("_old"))
    b = wanted.select(key, F.struct(*[F.col(c) for c in cols]).alias("_new"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "disable").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    pick = lambda c: F.when(F.col("_new").isNull(), F.lit(False) if c == "enabled" else F.col(f"_old.{c}")).otherwise(F.coalesce(F.col("_new.enabled"), F.lit(True)) if c == "enabled" else F.col(f"_new.{c}"))
    return both.select(key, *[pick(c).alias(c) for c in cols], action.alias("action"))


def snapshots(pages: DataFrame) -> DataFrame:
    """Raw page snapshots with content hash, size and content-addressed name."""
    h = F.sha2(F.coalesce("html", F.lit("")), 256)
    return pages.select("page_id", "url", "html").withColumn("content_hash", h).withColumn("n_bytes", F.octet_length(F.coalesce("html", F.lit(""))).cast("long")).withColumn("blob", F.concat(F.substring("content_hash", 1, 2), F.lit("/"), F.col("content_hash")))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def new_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages whose (url, content hash) isn't in the state of an earlier crawl."""
    return snapshots(pages).join(state.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def crawl_state(pages: DataFrame, state: DataFrame, key: str = "url") -> DataFrame:
    """pages with `state`: new (url, or other key, not seen), unchanged (same content hash) or changed, against an earlier crawl's
    snapshots."""
    seen = state.groupBy(key).agg(F.max_by("content_hash", "page_id").alias("_seen"))
    now = snapshots(pages).join(seen, key, "left")
    return now.withColumn("state", F.when(F.col("_seen").isNull(), "new").when(F.col("_seen") == F.col("content_hash"), "unchanged").otherwise("changed")).drop("_seen")


def metrics(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each table, below path."""
    for name, t in tables.items():
        t.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def materialize(df: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Appends df to the table at path and gives the newest row a key: results are kept, reads see the last."""
    df.write.mode("append").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def zips(latest: DataFrame, pages: DataFrame, key: str = "competitor_id") -> DataFrame:
    """key, zip binary: an archive a competitor of its newest JSON and its pages' html. Archives are made where a key's rows
    meet; pages beyond what fits into a row belong into several keys."""
    a = latest.groupBy(key).agg(F.to_json(F.max(F.struct(*[c for c in latest.columns if c != key]))).alias("_json"))
    b = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("_pages"))

    def run(it):
        import io
        import zipfile

        import pandas as pd

        for pdf in it:
            out = []
            for text, rows in zip(pdf["_json"], pdf["_pages"], strict=True):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("latest.json"), text or "{}")
                    for r in [] if rows is None else rows:
                        z.writestr(zipfile.ZipInfo(f"pages/{r['page_id']}.html"), r["html"] or "")
                out.append(buf.getvalue())
            yield pd.DataFrame({key: pdf[key], "zip": out})

    kind = latest.schema[key].dataType.simpleString()
    return a.join(b, key, "full_outer").mapInPandas(run, f"{key} {kind}, zip binary")

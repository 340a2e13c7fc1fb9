"""The type of a page by four independent signals: its address, its headings, its structured data and its head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.page_types import ADDRESSES, HEADINGS, OG_TYPES, PAGE_TYPES, SCHEMA, TITLE_SHARE
from marketspark.operators.dom import attr

_SCORED = "array<struct<type:string,score:double>>"


def best(scores: Column) -> Column:
    """struct(score, order, type) of the highest score, ties by the order of PAGE_TYPES; null for none above 0."""
    order = F.array(*[F.lit(x) for x in PAGE_TYPES])
    ranked = F.transform(F.filter(scores, lambda x: x["score"] > 0), lambda x: F.struct(x["score"].alias("score"), (-F.array_position(order, x["type"])).alias("order"), x["type"].alias("type")))
    return F.array_max(ranked)


def _scores(values: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("type"), F.coalesce(v, F.lit(0.0)).alias("score")) for t, v in values.items()])


def by_address(url: Column) -> Column:
    low = F.lower(url)

    def first(patterns: dict[str, float]) -> Column:
        out = F
        for pattern, weight in patterns.items():
            out = out.when(low.rlike(pattern), weight)
        return out.otherwise(0.0)

    return _scores({t: first(p) for t, p in ADDRESSES.items()})


def by_heading(text: Column) -> Column:
    """Scores of one heading."""
    low = F.lower(text)
    return _scores({t: F.greatest(*[F.when(low.rlike(p), w).otherwise(0.0) for p, w in ps.items()], F.lit(0.0)) for t, ps in HEADINGS.items()})


def by_title(title: Column) -> Column:
    """The patterns of addresses looked for in a title; the one for a bare host says nothing there."""
    low = F.lower(title)
    told = {t: {p.replace("\\", ""): w for p, w in ps.items() if not p.startswith("^")} for t, ps in ADDRESSES.items()}
    return _scores({t: F.round(TITLE_SHARE * F.greatest(*[F.when(low.rlike(p), w).otherwise(0.0) for p, w in ps.items()], F.lit(0.0)), 9) for t, ps in told.items()})


def page_types(pages: DataFrame, t: DataFrame, key: str, url: str = "url") -> DataFrame:
    """key, type, confidence, signals: each signal votes for its best type with its score, scores of a type add up, and the
    confidence is the winner's sum over the number of signals that voted, 0.95 at most. Without any it is unknown with 0.1.

    pages: a row a page with its address; t: dom.tree() of them. Null addresses and pages without html give no votes."""
    heads = t.where("tag = '#text'").select(key, "node", "text", F.explode(F.arrays_zip(F.col("up").alias("u"), F.col("above").alias("a"))).alias("z")).where("z.a in ('h1', 'h2', 'h3')")
    heads = heads.groupBy(key, F.col("z.u").alias("h")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"])).alias("text"))
    votes = heads.select(key, F.explode(by_heading(F.col("text"))).alias("s")).select(key, F.lit("heading").alias("signal"), "s.*")
    ld = t.where((F.col("tag") == "script") & (attr("type") == "application/ld+json")).select(key, F.col("node").alias("parent"))
    v = t.where("tag = '#script'").join(ld, [key, "parent"]).groupBy(key, "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "").alias("text"))
    v = v.select(key, F.try_parse_json("text").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    types = F.create_map(*[F.lit(x) for kv in SCHEMA.items() for x in kv])
    schema = v.select(key, F.explode(items).alias("i")).select(key, F.lit("schema").alias("signal"), F.try_element_at(types, F.try_variant_get("i", "$['@type']", "string")).alias("type"), F.lit(0.8).alias("score")).where("type is not null")
    title = t.where("tag = '#text' and above[0] = 'title'").groupBy(key).agg(F.min_by("text", "node").alias("text"))
    title = title.select(key, F.explode(by_title(F.col("text"))).alias("s"))
    og = t.where((F.col("tag") == "meta") & (attr("property") == "og:type")).groupBy(key).agg(F.lower(F.min_by(attr("content"), "node")).alias("c"))
    told = F
    for word, (kind, weight) in OG_TYPES.items():
        told = told.when(F.contains("c", F.lit(word)), F.struct(F.lit(kind).alias("type"), F.lit(weight).alias("score")))
    meta = title.unionByName(og.select(key, told.alias("s")).where("s is not null")).select(key, F.lit("meta").alias("signal"), "s.*")
    address = pages.select(key, F.lit("url").alias("signal"), F.explode(by_address(F.col(url))).alias("s")).select(key, "signal", "s.*")
    every = votes.unionByName(schema).unionByName(meta).unionByName(address).where("score > 0")
    scores = F.collect_list(F.struct("type", "score"))
    won = every.groupBy(key, "signal").agg(best(scores).alias("b")).where("b is not null")
    summed = won.groupBy(key, F.col("b.type").alias("type")).agg(F.sum("b.score").alias("score"), F.collect_list("signal").alias("by"))
    top = summed.groupBy(key).agg(best(F.collect_list(F.struct("type", "score"))).alias("t"), F.array_sort(F.flatten(F.collect_list("by"))).alias("signals"))
    out = pages.select(key).join(top, key, "left")
    return out.select(key, F.coalesce("t.type", F.lit("unknown")).alias("type"), F.when(F.col("t").isNotNull(), F.least(F.lit(0.95), F.col("t.score") / F.size("signals"))).otherwise(0.1).alias("confidence"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"))

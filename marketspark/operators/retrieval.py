"""Retrieval: chunks, hash embeddings, nearest vectors, hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.relational import top_n_per_key

#: Vectors of a block; two blocks meet in one matrix product.
BLOCK = 4096


def chunks(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """chunk_id, source_type, source_id, content (2000 characters at most) and words (distinct, longer than two characters)."""
    t = F.coalesce(F.col(text), F.lit(""))
    name = F.concat_ws(":", F.lit(kind), F.col(key), F.substring(F.md5(F.substring(t, 1, 200)), 1, 8))
    words = F.array_distinct(F.filter(F.split(F.trim(F.lower(t)), r"\s+"), lambda w: F.length(w) > 2))
    return df.select(name.alias("chunk_id"), F.lit(kind).alias("source_type"), F.col(key).alias("source_id"), F.substring(t, 1, 2000).alias("content"), words.alias("words"), hash_embedding(t).alias("embedding"))


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """A unit vector from a text's SHA-512: sixteen words of it as numbers from -1 to 1, the other dimensions 0. It knows equal
    texts and nothing else."""
    h = F.sha2(F.lower(text), 512)
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967295.0 * 2 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.concat(F.transform(raw, lambda x: x / norm), F.array_repeat(F.lit(0.0), dim - 16))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def hybrid_search(index: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The n chunks of most 0.6 * cosine + 0.4 * share of the query's words, with match_type. Ties go by chunk_id."""
    asked = list(dict.fromkeys(query.lower().split()))
    sem = cosine(F.col("embedding"), hash_embedding(F.lit(query)))
    words = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    kw = F.size(F.array_intersect("words", words)) / F.lit(float(max(1, len(asked))))
    kind = F.when((F.col("sem") > 0.1) & (F.col("kw") > 0.1), "hybrid").when(F.col("sem") > F.col("kw"), "semantic").otherwise("keyword")
    scored = index.withColumn("sem", sem).withColumn("kw", kw).select("chunk_id", "source_type", "source_id", (0.6 * F.col("sem") + 0.4 * F.col("kw")).alias("score"), kind.alias("match_type"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(n)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """query_id, <key>, score: for each of queries its n nearest rows by cosine (6 digits), itself left out, ties by key.

    Blocks of queries meet blocks of rows; each pair of blocks is one matrix product and leaves n rows a query."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        count = max(1, -(-df.count() // BLOCK))
        at = F.pmod(F.xxhash64(key), F.lit(count))
        return df.groupBy(at.alias(f"{name}_block")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))).alias(name))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                (qk, q), (rk, r) = (_block(batch.column(c)[i]) for c in (0, 1))
                score = np.round(q @ r.T, 6)
                score[qk[:, None] == rk[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(rk, score.shape), -score), axis=1)[:, :n]
                who = np.repeat(np.arange(len(qk)), order.shape[1])
                at = order.ravel()
                ok = np.isfinite(score[who, at])
                yield pa.RecordBatch.from_arrays([pa.array(qk[who[ok]]), pa.array(rk[at[ok]]), pa.array(score[who, at][ok])], ["query_id", key, "score"])

    pairs = blocks(queries, "q").crossJoin(blocks(rows, "r")).select("q", "r")
    best = pairs.repartition(F.xxhash64("q"), F.xxhash64("r")).mapInArrow(run, f"query_id long, {key} long, score double")
    return top_n_per_key(best, ["query_id"], [F.desc("score"), F.col(key)], n).drop("rank")


def _block(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a block."""
    item = x.values
    v = item.field(1)
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return item.field(0).to_numpy(zero_copy_only=False), m / np.where(norm > 0, norm, 1)

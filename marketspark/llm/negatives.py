"""Hard negatives by exact integer scores from Kronecker-packed products.

Components are integers. Biased to be at least 0, component d of all candidates of a cell goes into separated fields of one
wide integer, so that one multiplication by the anchor's (biased) component d makes that product for every candidate. The
sum over d has each candidate's sum in its field: fields are as wide as the largest possible sum, so none runs over. What
the biases added is taken off again, and the scores are exact.

Anchors are a stated query set. Tiles of some candidates by some anchors cover anchors times candidates; a tile keeps each
anchor's best few, and the best of all tiles are picked by a ranked window. Positives come first; their scores are the
bounds of the negatives, which a second pass over the tiles finds.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import release, stored, tidy

#: Candidates and anchors of a tile, at most about: a tile gives a few rows for each of its anchors.
CANDIDATES, ANCHORS = 4096, 256


class Packed:
    """Candidates of a tile, packed. vectors: integers, a row a candidate; shorter ones are filled with zeros."""

    def __init__(self, vectors: list[np.ndarray], most: int):
        """most: the largest absolute value of an anchor's component."""
        self.n, self.dim = len(vectors), max((len(v) for v in vectors), default=0)
        table = np.zeros((self.n, self.dim), object)
        for i, v in enumerate(vectors):
            table[i, : len(v)] = v
        self.bias = max(0, -int(table.min())) if table.size else 0
        top = (int(table.max()) + self.bias) if table.size else 0
        self.anchor_bias = most
        self.bits = next(b for b in (*(16, 32, 64), *range(128, 1 << 20, 64)) if self.dim * 2 * most * top < 1 << b)
        # Scores and what the biases add fit 62 bits, or stay Python integers.
        self.small = self.dim * 4 * max(most, 1) * max(top, 1) < 1 << 62
        table += self.bias
        self.total = table.sum(axis=1)
        if self.small:
            fields = table.astype(np.int64).T.astype(f"<u{self.bits // 8}")
            self.wide = [int.from_bytes(np.ascontiguousarray(row).tobytes(), "little") for row in fields]
            self.total = self.total.astype(np.int64)
        else:
            step = self.bits // 8
            self.wide = [int.from_bytes(b"".join(int(x).to_bytes(step, "little") for x in row), "little") for row in table.T]

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner products of the anchor with all candidates: 64-bit integers where they are sure to fit."""
        a = [int(x) for x in anchor[: self.dim]]
        biased = [x + self.anchor_bias for x in a] + [self.anchor_bias] * (self.dim - len(a))
        product = sum(map(operator.mul, self.wide, biased))
        raw = product.to_bytes(self.n * self.bits // 8, "little")
        if self.small:
            out = np.frombuffer(raw, f"<u{self.bits // 8}").astype(np.int64)
        else:
            step = self.bits // 8
            out = np.array([int.from_bytes(raw[k : k + step], "little") for k in range(0, len(raw), step)], object)
        # sum (a + b)(c + e) = sum ac + b sum (c + e) + e sum a; total already holds c + e.
        return out - self.anchor_bias * self.total - self.bias * sum(a)


def best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest allowed scores, ties by smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = score[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def prepared(df: DataFrame, id_col: str, vector: str, scale: int, label: Column) -> DataFrame:
    """key, id, label, q: the rows that take part, each distinct one once, with whole components floor(scale * x) as text
    where they don't fit a long (lists of decimal digits), else as longs."""
    fine = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    q = F.transform(vector, lambda x: scale * x.cast("double"))
    rows = df.where(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), q.alias("q"))
    return rows.dropDuplicates(["id", "label", "q"]).withColumn("key", F.xxhash64("id", "label", "q"))


def _whole(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<double> column, rounded down: 64-bit integers, or Python ones where they are larger."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    flat = flat.astype(np.int64) if not len(flat) or np.abs(flat).max() < 2**53 else np.array([int(x) for x in flat], object)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _tiles(anchors: DataFrame, rows: DataFrame, tile, schema: str) -> DataFrame:
    """tile(anchors, rows) of every pair of a share of anchors and a share of rows."""
    na, nr = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-rows.count() // CANDIDATES))
    share = lambda n: F.pmod(F.xxhash64("key", F.lit("share")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", share(na)).withColumn("j", every(nr))
    right = rows.withColumn("j", share(nr)).withColumn("i", every(na))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(tile, schema)


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor's place, id, scores with all rows)."""
    mine, theirs = (_whole(t.column("q").combine_chunks()) for t in (anchors, rows))
    most = max((int(np.abs(v).max()) for v in mine if len(v)), default=0)
    packed = Packed(theirs, most)
    for k, (v, at) in enumerate(zip(mine, anchors.column("id").to_pylist(), strict=True)):
        yield k, at, packed.scores(v)


def _out(values: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*values, strict=True) if values else [[] for _ in names], kinds, strict=True)], names)


_SCORE = pa.decimal128(38, 0)


def mine(df: DataFrame, id_col: str, vector: str, label: Column, is_anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of floor(scale * x) with the anchor's. Positives of an anchor: its first `positives`
    other rows of the same label, by score, ties by id. Negatives of an anchor and positive: the first `negatives` rows of
    another label with low * positive <= 100 * score <= high * positive. is_anchor is over `id`.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part. A row that repeats
    counts once; rows of one id that differ are rows of their own, and are no positives of each other. Vectors of unequal
    length: the shorter one ends in zeros. Scores beyond 38 digits are an error. Anchors without positives, and pairs
    without negatives, give no rows; an empty table gives none. Other columns are not read.
    """
    spark = df.sparkSession
    rows = stored(prepared(df, id_col, vector, scale, label))
    anchors = rows.where(is_anchor)

    def positives_of(a: pa.Table, r: pa.Table) -> pa.Table:
        out, names = [], ["key", "id", "positive_id", "score"]
        if a.num_rows and r.num_rows:
            ids, labels = r.column("id").to_numpy(), np.array(r.column("label").to_pylist(), object)
            keys, own = a.column("key").to_pylist(), a.column("label").to_pylist()
            for k, at, score in _scored(a, r):
                for i in best(score, ids, (labels == own[k]) & (ids != at), positives):
                    out.append((keys[k], at, int(ids[i]), int(score[i])))
        tidy()
        return _out(out, names, [pa.int64(), pa.int64(), pa.int64(), _SCORE])

    first = _tiles(anchors, rows, positives_of, "key long, id long, positive_id long, score decimal(38,0)")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "positive_id"))
    found = stored(first.withColumn("place", place).where(F.col("place") <= positives))
    release(spark)
    pairs = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))
    asking = stored(anchors.join(pairs, "key").select("key", "id", "label", "q", F.transform("positives", lambda x: x["positive_id"]).alias("p"), F.transform("positives", lambda x: x["score"]).alias("s")))

    def negatives_of(a: pa.Table, r: pa.Table) -> pa.Table:
        out, names = [], ["key", "id", "positive_id", "positive_score", "negative_id", "score"]
        if a.num_rows and r.num_rows:
            ids, labels = r.column("id").to_numpy(), np.array(r.column("label").to_pylist(), object)
            keys, own, p, s = (a.column(c).to_pylist() for c in ("key", "label", "p", "s"))
            for k, at, score in _scored(a, r):
                other = labels != own[k]
                for q, bound in zip(p[k], s[k], strict=True):
                    least, most = -(-low * int(bound) // 100), high * int(bound) // 100
                    for i in best(score, ids, other & (score >= least) & (score <= most), negatives) if least <= most else ():
                        out.append((keys[k], at, q, int(bound), int(ids[i]), int(score[i])))
        tidy()
        return _out(out, names, [pa.int64(), pa.int64(), pa.int64(), _SCORE, pa.int64(), _SCORE])

    schema = "key long, id long, positive_id long, positive_score decimal(38,0), negative_id long, score decimal(38,0)"
    second = _tiles(asking, rows, negatives_of, schema)
    rank = F.row_number().over(Window.partitionBy("key", "positive_id", "positive_score").orderBy(F.col("score").desc(), "negative_id"))
    out = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows for op13: labels of ids divisible by 7 are one higher, anchors have ids divisible by 100. Scores
    that a long doesn't hold are null."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine(embeddings, "vec_id", "embedding", label, F.col("id") % 100 == 0)
    return out.withColumns({c: F.col(c).try_cast("long") for c in ("positive_score", "negative_score")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """WITH q AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = q.label AS same, q.vec_id, list_dot_product(a.v, q.v)::BIGINT AS score
  FROM q a, q WHERE a.vec_id % 100 = 0 AND a.vec_id <> q.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score QUALIFY rank <= 10"""

"""Graphs as edge DataFrames (src, dst): two-hop pairs, components, breadth-first paths, influence. The iterative ones run
jobs: rounds are checkpointed to the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the context's folder: the one that is set, else spark.checkpoint.dir, else (a local session only) a
    temporary one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marketspark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over edges taken both ways. Self loops keep lone nodes."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("component").alias("m"))
        new = label.join(near, label.node == near.src, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(new.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        label = new


def distances(edges: DataFrame, start: int, most: int = 5) -> DataFrame:
    """node, depth: least number of directed edges from start, `most` at most."""
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, most + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hops(members: DataFrame, start: int, most: int = 5) -> DataFrame:
    """node, depth: as distances(), over members (member, grp) of a group in common, from smaller to greater member. Pairs of a
    group are never listed: a front's groups are gone through once a round."""
    seen = members.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    front = seen.select("node")
    for k in range(1, most + 1):
        least = front.join(members, front.node == members.member).groupBy("grp").agg(F.min("node").alias("from"))
        near = members.join(least, "grp").where(F.col("member") > F.col("from")).select(F.col("member").alias("node")).distinct()
        front = cut(near.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(k)))
    return seen


def neighbors(edges: DataFrame, node: int, *, reverse: bool = False, rel: str | None = None) -> DataFrame:
    """direction, rel, node: what a node's edges (rel, src, dst) lead to, or come from, of one relation or all."""
    mine, other = ("dst", "src") if reverse else ("src", "dst")
    hit = edges.where(F.col(mine) == node)
    if rel is not None:
        hit = hit.where(F.col("rel") == rel)
    return hit.select(F.lit("in" if reverse else "out").alias("direction"), "rel", F.col(other).cast("long").alias("node"))


#: Pairs of members meet in TILES * TILES squares, so that a member goes out 2 * TILES times, however many there are;
#: so many members of the same groups go together.
TILES, TOGETHER = 32, 256


def sharing(members: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """a, b, shared: pairs of members (a < b) of (member, grp), rows of which are distinct, with the number of groups that both
    are in, 1 at least. without: pairs (src, dst), or a row a member (src, dsts), that are left out; src < dst.

    A row a pair, made where two tiles meet and never shuffled: groups are bits, and common ones are counted once for a member
    and all those that are in the same groups."""
    from pyspark.sql import Window

    spark = members.sparkSession
    ids = members.select("grp").distinct().withColumn("i", F.row_number().over(Window.orderBy("grp")) - 1)
    words = -(-ids.count() // 63)
    bits = members.join(ids, "grp").groupBy("member", F.expr("i div 63").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i % 63 as int)))").alias("x"))
    m = bits.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    m = cut(m.select("member", F.transform(F.sequence(F.lit(0), F.lit(max(0, words - 1))), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("x")))
    tile = lambda c: F.pmod(F.hash(c), F.lit(TILES))
    every = F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))
    a = m.select(F.col("member").alias("a"), F.col("x").alias("xa"), tile("member").alias("ta"), every.alias("tb"))
    alike = m.groupBy(tile("member").alias("tb"), F.col("x").alias("xb")).agg(F.array_sort(F.collect_list("member")).alias("_all"))
    alike = alike.select("tb", "xb", "_all", F.explode(F.expr(f"sequence(0, (size(_all) - 1) div {TOGETHER})")).alias("_k"))
    b = alike.select("tb", "xb", F.expr(f"slice(_all, {TOGETHER} * _k + 1, {TOGETHER})").alias("_b"), every.alias("ta"))
    if without is not None:
        pairs = without.select("src", F.explode("dsts").alias("dst")) if "dsts" in without.columns else without
        linked = pairs.groupBy("src", tile("dst").alias("tb")).agg(F.collect_list("dst").alias("_linked"))
        a = a.join(linked.withColumnRenamed("src", "a"), ["a", "tb"], "left")
    n = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.bit_count(p.bitwiseAND(q)).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    if words <= 16:  # the same sum written out, which is compiled
        n = reduce(add, [F.bit_count(F.col("xa")[w].bitwiseAND(F.col("xb")[w])).cast("long") for w in range(words)], F.lit(0).cast("long"))
    # The tables are small, their pairs are not: their number says nothing of how many tasks are due.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = a.repartition(parts, "ta", "tb").join(b.repartition(parts, "ta", "tb"), ["ta", "tb"])
    met = met.where(F.element_at("_b", -1) > F.col("a")).withColumn("shared", n).where("shared > 0")
    if without is not None:
        met = met.withColumn("_b", F.when(F.col("_linked").isNull(), F.col("_b")).otherwise(F.array_except("_b", "_linked")))
    return met.select("a", F.explode("_b").alias("b"), "shared").where("a < b")


#: Groups of so many neighbouring ids meet in one block, and so many members of a group at a time; so many members
#: that a task holds of groups, and pairs that it marks, at a time.
BLOCK, PART, HELD, MARKED = 32768, 256, 1 << 22, 1 << 26


def _pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """src, and the offsets and values of their greater partners, each once, for rows (members, partners), both without repeats."""
    members, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    partners, to = np.unique(np.concatenate([y for _, y in rows]), return_inverse=True)
    i, j = (np.cumsum([0, *(len(r[side]) for r in rows)]) for side in (0, 1))
    step = max(1, MARKED // len(partners))
    for lo in range(0, len(members), step):
        seen = np.zeros((min(step, len(members) - lo), len(partners)), bool)
        for k in range(len(rows)):
            mine = at[i[k] : i[k + 1]] - lo
            if step < len(members):
                mine = mine[(mine >= 0) & (mine < len(seen))]
            seen[mine[:, None], to[j[k] : j[k + 1]]] = True
        seen &= members[lo : lo + step, None] < partners
        src, dst = np.nonzero(seen)
        start = np.flatnonzero(np.diff(src, prepend=-1))
        yield members[lo + src[start]], np.append(start, len(src)), partners[dst]


def linked(members: DataFrame) -> DataFrame:
    """src, dsts: for each member its greater ones that share a group, each once. members: (member, grp) of integers, rows may be
    repeated; members that have no greater ones are left out.

    No row a pair is shuffled: the members of a block's groups are marked in one table, whose lines are brought together by member."""
    kind = members.schema["member"].dataType.simpleString()
    groups = members.withColumn("_block", F.expr(f"grp div {BLOCK}")).groupBy("_block", "grp").agg(F.array_sort(F.collect_set("member")).alias("_all")).where(F.size("_all") > 1)
    parts = groups.select("_block", "_all", F.explode(F.expr(f"sequence(0, (size(_all) - 1) div {PART})")).alias("_k")).withColumn("_part", F.expr(f"slice(_all, {PART} * _k + 1, {PART})"))
    dealt = parts.repartition("_block", "_k").sortWithinPartitions("_block", "_k").select("_block", "_k", "_all", "_part")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            for src, offsets, dst in _pairs(rows) if rows else ():
                for lo in range(0, len(src), 4096):
                    o = offsets[lo : lo + 4097]
                    lists = pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(dst[o[0] : o[-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(src[lo : lo + 4096]), lists], ["src", "_rest"])

        rows, size, last = [], 0, None
        for batch in it:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            values, ends = ([c.flatten().to_numpy() for c in batch.columns[2:]], [np.append(0, np.cumsum(pa.compute.list_value_length(c).to_numpy())) for c in batch.columns[2:]])
            for k, key in enumerate(keys):
                if rows and (key != last or size > HELD):
                    yield from made()
                    rows, size = [], 0
                last = key
                rows.append(tuple(v[e[k] : e[k + 1]] for v, e in zip(values, ends, strict=True)))
                size += len(rows[-1][0])
        yield from made()

    near = dealt.mapInArrow(run, f"src {kind}, _rest array<{kind}>")
    return near.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("_rest"))).alias("dsts"))


def influence(links: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, score: rank over directed edges, without giving back the rank of nodes that have no edges out. links: edges (src, dst),
    or a row a node with all its edges (src, dsts), which are then not shuffled."""
    if "dsts" not in links.columns:
        links = links.groupBy("src").agg(F.collect_list("dst").alias("dsts"))
    out = cut(links.select("src", "dsts", F.size("dsts").alias("k")))
    nodes = cut(out.select(F.col("src").alias("node")).unionByName(out.select(F.explode("dsts").alias("node"))).distinct())
    n = nodes.count()
    rank = nodes.withColumn("score", F.lit(1.0 / max(1, n)))
    for k in range(rounds):
        share = out.join(rank, out.src == rank.node).select("dsts", (F.col("score") / F.col("k")).alias("share"))
        part = share.select(F.explode("dsts").alias("node"), "share").groupBy("node").agg(F.sum("share").alias("s"))
        rank = nodes.join(part, "node", "left").select("node", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
        if k % 5 == 4:
            rank = cut(rank)
    return rank

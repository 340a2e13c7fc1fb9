"""Exact Jaccard self-join on word shingles: size-banded tiles, hashed bitmaps, bit counts, sorted-array intersection.

Equal sets are one node, with one stored bitmap. A node of size s can only link to sizes between 0.9 s and s / 0.9, so sizes
fall into bands of that ratio and a node meets its own band and the two beside it (a tile is two bands).

Prefilter: two sets that link, the smaller of them in a tile's lower band, differ in d shingles at most. Dealt by hash into
more than d parts, one part at least is the same in both: the parts' hashes are the keys by which sets come together,
without a cap. Keys that bring the same nodes together count once, wherever they were met. Of the nodes that share a key,
sizes and bit counts rule out pairs; the others tie nodes into loose groups.

Tiles: a group's nodes are dealt into cells of bounded size (a band, or a share of one), and every tile of two cells of one
band or of neighbouring bands is compared pair by pair: the bits of the stored bitmaps that one set has and the other lacks
bound the overlap from above, and what passes is settled by intersecting the sorted arrays. Nodes that are tied already are
not compared again. Links found tie components; each round of contraction is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import LOWER, batches, byte_view, discard, documents, extended, fresh, mix, partitions, release, span_hashes, stored, word_spans

#: Nodes of a cell.
CELL = 1024
#: Keys that a task gathers before it sends them, and nodes among them that share a key one by one; beyond, one stands for
#: them.
KEYS, HOT = 400_000, 300
#: A part of fewer shingles says little; it is a key only for sets that have too many of them.
WEAK = 3


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the bands; sets that link lie in one band or in two that follow each other. Below the first, only
    equal sets link."""
    first = -(-percent // (100 - percent))  # sizes s and s + 1 can link
    out = [first]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    out.append(out[-1] * 100 // percent + 1)
    return np.array(out + [out[-1] * 100 // percent + 1], np.int64)


def tiles(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tile (bands t and t + 1): parts, and weak parts that a set may leave out.

    A tile answers for the links whose smaller set is in its lower band. With sizes a <= b those differ in
    (a + b) (1 - p) / (1 + p) shingles at most, and b is a / p at most, which makes a (1 - p) / p."""
    b = bands(percent, most)
    differ = (b[1:-1] - 1) * (100 - percent) // percent
    spare = differ // 20
    return differ + 1 + spare, spare


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles over lower-cased (A-Z) words; of fewer words, the whole
    sequence is one; without words, none."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets)
    h = span_hashes(low, starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    at = np.append(0, np.cumsum(count))
    key = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        key = mix(key + h[k : k + len(key)])
    out = []
    for i, c in enumerate(count):
        if c >= n:
            out.append(np.unique(key[at[i] : at[i] + c - n + 1]))
        elif c:
            short = np.full(1, c, np.uint64)
            for x in h[at[i] : at[i + 1]]:
                short = mix(short + np.uint64(0x632BE59BD9B4E019) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A set's key; equal sets have equal keys."""
    total = np.array([np.add.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15))), np.uint64(len(s))], np.uint64)
    return int((mix(total[:1]) ^ mix(mix(total[1:]))).view(np.int64)[0])


def keys_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) for the parts of every set that may link to another one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = bands(percent, 1 << max(10, int(sizes.max(initial=1)).bit_length()))
    parts, spare = tiles(percent, 1 << max(10, int(sizes.max(initial=1)).bit_length()))
    found = ([], [])
    use = np.flatnonzero(sizes >= edges[0])
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.concatenate([sets[i] for i in use])
    size = sizes[use]
    band = np.searchsorted(edges, size, "right") - 1
    mixed = mix(every ^ np.uint64(0xA0761D6478BD642F))
    slot = mix(every + np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)
    for back in (0, 1):
        tile = band - back
        ok = tile >= 0
        g = np.where(ok, parts[np.maximum(tile, 0)], 0)
        base = np.append(0, np.cumsum(g))
        who = np.repeat(np.arange(len(use)), size)
        live = ok[who]
        w = who[live]
        to = base[w] + (slot[live] * g[w].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total, count = np.zeros(base[-1], np.uint64), np.bincount(to, minlength=base[-1])
        np.add.at(total, to, mixed[live])
        owner = np.repeat(np.arange(len(use)), g)
        weak = count < WEAK
        few = np.bincount(owner[weak], minlength=len(use)) <= np.where(ok, spare[np.maximum(tile, 0)], 0)
        take = ~(weak & few[owner])
        number = np.arange(base[-1]) - base[owner]
        key = mix(mix(total) + mix((number << 20 | tile[owner]).astype(np.uint64)) + count.astype(np.uint64))
        found[0].append(key[take].view(np.int64))
        found[1].append(use[owner[take]])
    return np.concatenate(found[0]), np.concatenate(found[1])


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the graph of the edges (u, v), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> the same components' edges to their smallest node, by batch."""
    for b in it:
        n, r = smallest(b.column(0).to_numpy(), b.column(1).to_numpy())
        keep = n != r
        yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(r[keep])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (long): the components of edges (u, v), long. Rounds of contraction to the smallest neighbour; each is
    written to the shared folder. Edges to itself and repeated ones do no harm; nodes without edges have no row."""
    spark = edges.sparkSession
    edges = stored(edges.where("u <> v").mapInArrow(_local, "u long, v long").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
        maps.append(low)
        a, b = low.select(F.col("node").alias("u"), F.col("root").alias("ru")), low.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = stored(edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).mapInArrow(_local, "u long, v long").distinct())
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps.pop()
    while maps:
        first = maps.pop()
        out = first.join(out.select(F.col("node").alias("root"), F.col("root").alias("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root")).unionByName(out.join(first.select("node"), "node", "left_anti"))
        out = stored(out)
    return out


def compare(node: np.ndarray, cell: np.ndarray, sets: list[np.ndarray], maps: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the nodes of a tile's two cells (or within one), enough of them to tie every component."""
    size = np.array([len(s) for s in sets], np.int64)
    root, found = np.arange(len(sets)), []
    for i, j in allowed(size, maps, percent, None if len(np.unique(cell)) == 1 else cell, root):
        for k in j:
            if root[k] == root[i]:
                continue
            both = size[i] + size[k] - len(np.union1d(sets[i], sets[k]))
            if 100 * both >= percent * (size[i] + size[k] - both):
                found.append((int(node[i]), int(node[k])))
                a, b = sorted((root[i], root[k]))
                root[root == b] = a
    return found


def classified(df: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles long, node long, root long, component_id (doc_id's type), a row for each of df's.

    Rows link when 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the smallest
    doc_id reachable by links, itself included. A null or empty text, or one without words, is linked with nothing (node
    null). Rows of equal doc_id are documents of their own. A null doc_id ties like any other, but gives a component_id
    only where a component has no other (then null). Columns of df besides doc_id and text are ignored; an empty table
    gives no rows. No cap on partners: every link between different texts counts.
    """
    docs = df.select("doc_id", "text")
    rows = stored(nodes(docs, "node", n, "bits").drop("text"))
    tied = components(links(docs, rows, n, percent))
    release(docs.sparkSession)
    rows = rows.drop("bits").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rows.where("node is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(first, "root", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "node", "root", own.alias("component_id"))


def representatives(df: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """df without near copies: of each component the row of the smallest doc_id stays (null last), whole; of rows that are
    equal in doc_id and set, one. Texts without words stay."""
    node, i, count = fresh(df, "node", "id", "count")
    rows = classified(df, n, percent).where("node is not null")
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("k")).select(_id("k.doc_id").alias(i), F.col("k.node").alias(node))
    every = nodes(df, node, n, count=count).withColumn(i, _id("doc_id"))
    some = every.where(F.col(node).isNotNull()).join(keep, [i, node]).dropDuplicates([i, node])
    return some.unionByName(every.where(F.col(node).isNull())).select(*[F.col(f"`{c}`") for c in df.columns])


def _id(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows for op4. Nulls, empty texts, repeated rows and empty tables: as in classified()."""
    return classified(docs).select("doc_id", "n_shingles", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


def nodes(df: DataFrame, name: str, n: int, bits: str | None = None, count: str = "n_shingles") -> DataFrame:
    """df with the number of shingles, the node's key (null: no shingle), and its bitmap where a column is named for it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            sets = shingles(data, offsets, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.array([node_of(s) for s in sets], np.int64)
            out = [*batch.columns, pa.array(sizes), pa.array(keys, mask=sizes == 0)]
            if bits:
                out.append(pa.array([bitmap(s).tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, count, name, *([bits] if bits else [])])

    schema = extended(df.schema, **{count: "long", name: "long"}, **({bits: "binary"} if bits else {}))
    return df.mapInArrow(run, schema)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit a shingle or more, 2 ** 16 at most: a power of two of them, so that two maps can be folded to one length."""
    m = min(1 << max(6, int(len(s) - 1).bit_length() if len(s) else 6), 1 << 16)
    words = np.zeros(m // 64, np.uint64)
    place = (mix(s ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(m - 1)).astype(np.int64)
    np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return words


def allowed(size: np.ndarray, maps: list[np.ndarray], percent: int, cell: np.ndarray | None, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): nodes whose sizes and bit counts allow a link, each pair once, leaving out what `root` (which the caller
    updates between steps) ties already and, with `cell`, pairs within a cell. Bits of one set that the other lacks are as
    many shingles at least. Maps of twice the length are folded."""
    order = np.argsort(size, kind="stable")
    place = np.empty(len(size), np.int64)
    place[order] = np.arange(len(size))
    length = np.array([len(m) for m in maps])
    grids = {L: (g := order[length[order] == L], np.stack([maps[k] for k in g])) for L in np.unique(length)}
    top = np.searchsorted(size[order] * percent, size * 100, "right")
    for i in order:
        for L in (length[i], 2 * length[i]):
            if L not in grids:
                continue
            j, grid = grids[L]
            at = place[j]
            lo, hi = np.searchsorted(at, place[i] + 1), np.searchsorted(at, top[i])
            j, grid = j[lo:hi], grid[lo:hi]
            ok = root[j] != root[i]
            if cell is not None:
                ok &= cell[j] != cell[i]
            if not ok.any():
                continue
            j, grid = j[ok], grid[ok]
            if L > length[i]:
                grid = grid[:, : L // 2] | grid[:, L // 2 :]
            most = np.minimum(size[i] - np.bitwise_count(maps[i] & ~grid).sum(1, dtype=np.int64), size[j] - np.bitwise_count(grid & ~maps[i]).sum(1, dtype=np.int64))
            j = j[(100 + percent) * most >= percent * (size[i] + size[j])]
            if len(j):
                yield int(i), j


def plausible(size: np.ndarray, maps: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a key's nodes whose sizes and bit counts allow a link, enough to tie what they tie."""
    root, u, v = np.arange(len(size)), [], []
    for i, j in allowed(size, maps, percent, None, root):
        for k in j:
            if root[k] != root[i]:
                u.append(i)
                v.append(k)
                a, b = sorted((root[i], root[k]))
                root[root == b] = a
    return np.array(u, np.int64), np.array(v, np.int64)


def links(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes: enough to tie every component. rows: doc_id, node, n_shingles and bits of docs."""
    spark = docs.sparkSession
    parts = partitions(spark)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        key, node, size = [], [], 0
        for _, data, offsets in batches(it):
            sets = [s for s in shingles(data, offsets, n) if len(s)]
            names = np.array([node_of(s) for s in sets], np.int64)
            new = [i for i, x in enumerate(names.tolist()) if not (x in seen or seen.add(x))]
            k, at = keys_of([sets[i] for i in new], percent)
            key.append(k)
            node.append(names[new][at] if len(at) else np.zeros(0, np.int64))
            size += len(k)
            if size > KEYS:
                yield from dealt_keys(np.concatenate(key), np.concatenate(node))
                seen.clear()
                key, node, size = [], [], 0
        if size:
            yield from dealt_keys(np.concatenate(key), np.concatenate(node))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        if not got or not sum(b.num_rows for b in got):
            return
        key, node, mark = unpacked(got)
        del got
        order = np.lexsort((node, key))
        key, node, mark = key[order], node[order], mark[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        # Keys of several nodes; keys of the same nodes are one: they go by a hash of the nodes.
        first = np.flatnonzero(~same)
        new = np.ones(len(key), bool)
        new[1:] = ~same[1:] | (node[1:] != node[:-1])
        count = np.add.reduceat(new.astype(np.int64), first)
        members = np.add.reduceat(np.where(new, mix(node.view(np.uint64)), np.uint64(0)), first)
        marked = np.maximum.reduceat(mark, first)
        members = mix(members + marked.astype(np.uint64)).view(np.int64)
        several = np.flatnonzero(count > 1)
        several = several[np.unique(members[several], return_index=True)[1]]
        block = np.cumsum(~same) - 1
        keep = new & np.isin(block, several)
        block = block[keep]
        t = pa.Table.from_arrays([pa.array(members[block]), pa.array(node[keep]), pa.array(marked[block])], ["key", "node", "mark"])
        yield from t.to_batches(max_chunksize=1 << 16)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        if not got or not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        key, node, size = (t.column(k).to_numpy() for k in range(3))
        mark = t.column(4).to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        u, v = [], []
        for rows_ in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(rows_) > 1 and (mark[rows_[0]] or len(rows_) > 4 * CELL):
                u.append(node[rows_[1:]])
                v.append(np.repeat(node[rows_[0]], len(rows_) - 1))
            elif len(rows_) > 1:
                a, b = plausible(size[rows_], [np.frombuffer(t.column(3)[int(i)].as_py(), np.uint64) for i in rows_], percent)
                u.append(node[rows_[a]])
                v.append(node[rows_[b]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    met = docs.select("text").mapInArrow(keyed, "route int, mark boolean, k binary, node binary").repartition(parts, "route").mapInArrow(meet, "key long, node long, mark boolean")
    met = stored(met.dropDuplicates(["key", "node"]))
    release(spark)
    maps = rows.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("bits").alias("bits"))
    met_maps = met.select("node").distinct().join(maps, "node")
    loose = components(met.join(met_maps, "node").select("key", "node", "n", "bits", "mark").repartition(parts, "key").mapInArrow(weigh, "u long, v long"))
    discard(met)
    # One document of each node in a loose group, with its bitmap; its set is counted again from the text.
    groups = loose.select("node", F.col("root").alias("grp"))
    chosen = rows.join(groups, "node").groupBy("node", "grp").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"))
    chosen = chosen.select("node", "grp", _id("doc_id").alias("id"), "bits")
    texts = docs.select(_id("doc_id").alias("id"), "text").join(chosen, "id").select("text", "node", "grp", "bits")
    edges = bands(percent, 1 << 40)

    def laid(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            sets = shingles(data, offsets, n)
            ok = [i for i, (s, x) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if len(s) and node_of(s) == x]
            sizes = np.array([len(sets[i]) for i in ok], np.int64)
            band = (np.searchsorted(edges, sizes, "right") - 1).astype(np.int32)
            at = pa.array(ok, pa.int64())
            items = pa.array([sets[i].tobytes() for i in ok], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), pa.array(band), batch.column(1).take(at), batch.column(3).take(at), items], ["grp", "band", "node", "bits", "items"])

    found = stored(texts.mapInArrow(laid, "grp long, band int, node long, bits binary, items binary"))
    del texts, chosen, groups, met_maps, maps
    release(spark)
    # A tile is two cells of one band of a group, or of two bands that follow each other.
    counts = found.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / F.lit(CELL)).cast("int"))
    cells = counts.select("grp", "band", (F.col("n") == 1).alias("alone"), F.explode(F.expr("sequence(0, shares - 1)")).alias("part"))
    a, b = (cells.select("grp", F.col("band").alias(f"b{x}"), F.col("part").alias(f"p{x}"), F.col("alone").alias(f"alone{x}")) for x in "ab")
    pairs = a.join(b, "grp").where("(ba = bb and pa <= pb and not alonea) or bb = ba + 1").withColumn("tile", F.xxhash64("grp", "ba", "pa", "bb", "pb"))
    ends = F.when((F.col("ba") == F.col("bb")) & (F.col("pa") == F.col("pb")), F.array(F.struct(F.col("ba").alias("band"), F.col("pa").alias("part"))))
    ends = ends.otherwise(F.array(F.struct(F.col("ba").alias("band"), F.col("pa").alias("part")), F.struct(F.col("bb").alias("band"), F.col("pb").alias("part"))))
    to = pairs.select("grp", "tile", F.explode(ends).alias("e")).groupBy("grp", F.col("e.band").alias("band"), F.col("e.part").alias("part")).agg(F.collect_list("tile").alias("tiles"))
    to = to.join(counts.select("grp", "band", "shares"), ["grp", "band"])
    dealt = found.join(to, ["grp", "band"]).where("pmod(node, shares) = part").select(F.explode("tiles").alias("tile"), F.expr("band * 1000000L + part").alias("cell"), "node", "bits", "items")

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        if not got or not sum(b.num_rows for b in got):
            return
        tile, cell, node = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(3))
        maps_, sets = ([np.frombuffer(x.as_py(), np.uint64) for b in got for x in b.column(k)] for k in (3, 4))
        del got
        order = np.argsort(tile, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0))
        out = []
        for at in np.split(order, edge[1:]):
            if len(at) > 1:
                out += compare(node[at], cell[at], [sets[i] for i in at], [maps_[i] for i in at], percent)
        if out:
            u, v = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    out = stored(dealt.repartition(parts, "tile").mapInArrow(settle, "u long, v long"))
    discard(found)
    return out


def dealt_keys(key: np.ndarray, node: np.ndarray, most: int = HOT) -> Iterator[pa.RecordBatch]:
    """packed() rows of the keys of some documents.

    A key that more than `most` of these nodes share: the smallest stands for them under it, and a key of their own ties them, so that it
    takes a row each time. Such rows are marked: what they stand for is compared later."""
    order = np.lexsort((node, key))
    k, v = key[order], node[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    first = np.flatnonzero(~same)
    count = np.diff(np.append(first, len(k)))
    hot = np.repeat(count > most, count)
    member = hot & same
    a, r = smallest(v[member], np.repeat(v[first], count)[member])
    tie = mix(r.view(np.uint64) + np.uint64(0x589965CC75374CC3)).view(np.int64)
    mark = hot[~member]
    k, v = k[~member], v[~member]
    del order, same, hot, member
    for marked, x, y in ((False, k[~mark], v[~mark]), (True, np.concatenate([k[mark], tie]), np.concatenate([v[mark], a]))):
        yield from packed(x, y, marked)


#: Bits of a key that deal its rows out: a row of the exchange holds the keys of one route.
ROUTE = 12


def packed(key: np.ndarray, node: np.ndarray, mark: bool) -> Iterator[pa.RecordBatch]:
    """Rows (route, mark, k, node): the lower six bytes of the keys of a route, which tell them apart with the route's bits,
    and their nodes."""
    if not len(key):
        return
    k = key.view(np.uint64)
    order = np.argsort(k)
    k, v = k[order], node[order]
    route = (k >> np.uint64(64 - ROUTE)).astype(np.int32)
    cut = np.flatnonzero(np.diff(route, prepend=-1, append=-1))
    low = np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    names = ["route", "mark", "k", "node"]
    columns = [pa.array(route[cut[:-1]]), pa.array(np.full(len(cut) - 1, mark))]
    for x, width in ((low, 6), (v, 8)):
        columns.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]))
    yield pa.RecordBatch.from_arrays(columns, names)


def unpacked(got: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (route and six bytes), nodes and marks of packed() rows."""
    parts = []
    for b in got:
        low, to = byte_view(b.column(2))
        node, _ = byte_view(b.column(3))
        k = np.zeros((len(low) // 6, 8), np.uint8)
        k[:, :6] = low.reshape(-1, 6)
        n = np.diff(to) // 6
        route = np.repeat(b.column(0).to_numpy().astype(np.uint64), n)
        key = (k.view("<u8").ravel() & np.uint64((1 << 48) - 1)) | (route << np.uint64(48))
        parts.append((key.view(np.int64), np.frombuffer(node.tobytes(), np.int64), np.repeat(b.column(1).to_numpy(zero_copy_only=False), n)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]

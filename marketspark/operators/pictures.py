"""Small grey pictures and their difference hashes: near pictures have near hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of bits; a row of the picture has a cell more, each bit compares two neighbours.
ROWS, COLUMNS = 8, 8
CELLS = ROWS * (COLUMNS + 1)
#: Fixed value: bits that differ at most between pictures of the same page.
SAME = 5


def drawn(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, grid: the picture of a text. Each word darkens the cell that its MD5 names, so a text that differs in a few words
    differs in a few cells. Texts without words, and null ones, are blank. Rows of equal keys are one picture."""
    words = rows.select(*keys, F.explode_outer(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")).alias("_w"))
    cell = (F.conv(F.substring(F.md5("_w"), 1, 6), 16, 10).cast("bigint") % CELLS).cast("int")
    counts = words.groupBy(*keys, cell.alias("_c")).agg(F.count("_w").alias("_n"))
    grid = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", "_n")))).alias("_m"))
    return grid.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double")).alias("grid"))


def difference_hash(grid: Column) -> Column:
    """64 bits of a picture of CELLS greys in reading order: whether each cell is lighter than its right neighbour."""
    at = lambda k: (F.floor(k / COLUMNS) * (COLUMNS + 1) + k % COLUMNS).cast("int")
    bits = F.transform(F.sequence(F.lit(0), F.lit(ROWS * COLUMNS - 1)), lambda k: F.when(grid[at(k)] < grid[at(k) + 1], F.lit(1)).otherwise(0).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def distance(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")

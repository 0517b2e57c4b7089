"""Grid expressions: cells, bins, boxes and space-filling curves, as Column expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True where a float is neither null, NaN nor infinite; never null."""
    d = c.cast("double")
    return F.coalesce((F.abs(d) < F.lit(float("inf"))) & ~F.isnan(d), F.lit(False))


def cell(c: Column, size: Column | float) -> Column:
    """Index of the half-open cell: floor(position / size), in double; a border value belongs to the upper cell."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    return F.floor(c.cast("double") / size.cast("double")).cast("bigint")


def chunk_key(cells: Sequence[Column]) -> Column:
    """Cells as text, ``3.-1.0``; null cells (axes beyond the dataset's ndim) are left out."""
    return F.concat_ws(".", *[c.cast("string") for c in cells])


def with_cells(vertices: DataFrame, root: DataFrame) -> DataFrame:
    """Keep the rows of ``vertices`` that have a cell and add ``cx, cy, cz`` (``cz`` null if ndim is 2).

    The cell is taken over the first ndim axes (up to three) from the root's chunk_shape of the row's dataset.
    Rows of an unknown dataset, and rows with a null, NaN or infinite coordinate among these axes, have no cell
    and are dropped.  ``root`` has one row per dataset; Catalyst broadcasts it while its files are small.
    """
    grid = root.select("dataset_id", F.col("ndim").alias("_nd"), F.col("chunk_shape").alias("_cs"))
    out = vertices.join(grid, "dataset_id")
    has = F.lit(True)
    for i, a in enumerate("xyz"):
        has = has & (finite(F.col(a)) | (F.col("_nd") <= i))
    axis = lambda i, a: F.when(F.col("_nd") > i, cell(F.col(a), F.get(F.col("_cs"), F.lit(i))))
    return out.filter(has).withColumns({f"c{a}": axis(i, a) for i, a in enumerate("xyz")}).drop("_nd", "_cs")


def in_box(axes: Sequence[str], lo: Sequence[float], hi: Sequence[float]) -> Column:
    """Closed box test on every axis."""
    return reduce(lambda a, b: a & b, [F.col(c).between(l, h) for c, l, h in zip(axes, lo, hi)])


def in_box_cells(cells: Sequence[str], lo: Sequence[float], hi: Sequence[float], size: Sequence[Column | float]) -> Column:
    """Cell ranges of a closed box, so that files partitioned or sorted by cell are pruned; null cells (absent axes) pass."""
    edge = lambda v, s: F.floor(F.lit(float(v)) / (s if isinstance(s, Column) else F.lit(float(s))))
    parts = [F.coalesce(F.col(c).between(edge(l, s), edge(h, s)), F.col(c).isNull()) for c, l, h, s in zip(cells, lo, hi, size)]
    return reduce(lambda a, b: a & b, parts)


def bin_to_chunk(b: Column, per_chunk: int) -> Column:
    """Chunk of a bin; floors, so negative bins go down."""
    return F.floor(b / F.lit(per_chunk)).cast("bigint")


def linear_fragment(bins: Sequence[Column], per_chunk: Sequence[int]) -> Column:
    """Row-major index of a bin inside its chunk."""
    out = F.lit(0).cast("bigint")
    for b, n in zip(bins, per_chunk):
        out = out * F.lit(n) + F.pmod(b, F.lit(n))
    return out.cast("bigint")


def unlinear_fragment(frag: Column, per_chunk: Sequence[int]) -> list[Column]:
    """Place of each axis inside the chunk, from a row-major index made by :func:`linear_fragment`."""
    return [F.pmod(F.floor(frag / F.lit(prod(per_chunk[i + 1 :]))), F.lit(n)).cast("bigint") for i, n in enumerate(per_chunk)]


def chunk_bins(chunk: Column, per_chunk: int) -> tuple[Column, Column]:
    """First and last bin of a chunk along an axis, both inside it."""
    return chunk * F.lit(per_chunk), chunk * F.lit(per_chunk) + F.lit(per_chunk - 1)


def morton(coords: Sequence[Column], bits: int = 21, offset: int = 0) -> Column:
    """Interleaved bits of non-negative cells (``offset`` is added first); bits * len(coords) may be 63 at most."""
    n = len(coords)
    if bits * n > 63:
        raise ValueError("more than 63 bits")
    code = F.lit(0).cast("bigint")
    moved = [(c + F.lit(offset)).cast("bigint") for c in coords]
    for k in range(bits):
        for i, c in enumerate(moved):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("bigint")), k * n + i))
    return code


def unmorton(code: Column, n: int, bits: int = 21) -> list[Column]:
    """The cells of a code made by :func:`morton` without offset."""
    out = []
    for i in range(n):
        c = F.lit(0).cast("bigint")
        for k in range(bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(code, k * n + i).bitwiseAND(F.lit(1).cast("bigint")), k))
        out.append(c)
    return out


def hilbert2d(x: Column, y: Column, order: int = 16) -> Column:
    """Position of a cell on the two-dimensional Hilbert curve of ``order`` bits, as one JVM-side fold over the bits."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) > 0, one).otherwise(zero)
        ry = F.when(a["y"].bitwiseAND(s) > 0, one).otherwise(zero)
        d = a["d"] + s * s * ((rx * F.lit(3)).bitwiseXOR(ry))
        low = s - one
        x0, y0 = a["x"].bitwiseAND(low), a["y"].bitwiseAND(low)
        fx, fy = F.when(rx == 1, low - x0).otherwise(x0), F.when(rx == 1, low - y0).otherwise(y0)
        nx, ny = F.when(ry == 0, fy).otherwise(x0), F.when(ry == 0, fx).otherwise(y0)
        return F.struct(nx.alias("x"), ny.alias("y"), d.alias("d"))

    sides = F.array(*[F.lit(1 << k).cast("bigint") for k in range(order - 1, -1, -1)])
    return F.aggregate(sides, start, step, lambda a: a["d"])


def gray(c: Column) -> Column:
    """Binary-reflected Gray code of a cell."""
    return c.bitwiseXOR(F.shiftright(c, 1))


def ungray(code: Column) -> Column:
    """The cell of a Gray code of up to 32 bits."""
    return F.aggregate(F.array(*map(F.lit, (1, 2, 4, 8, 16))), code, lambda a, k: a.bitwiseXOR(F.call_function("shiftright", a, k)))


def unhilbert2d(code: Column, order: int = 16) -> list[Column]:
    """The cell at a position of the curve of :func:`hilbert2d`."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    start = F.struct(zero.alias("x"), zero.alias("y"), code.cast("bigint").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["d"].bitwiseAND(F.lit(2)) > 0, one).otherwise(zero)
        ry = a["d"].bitwiseAND(one).bitwiseXOR(rx)
        fx, fy = F.when(rx == 1, s - one - a["x"]).otherwise(a["x"]), F.when(rx == 1, s - one - a["y"]).otherwise(a["y"])
        x, y = F.when(ry == 0, fy).otherwise(a["x"]), F.when(ry == 0, fx).otherwise(a["y"])
        return F.struct((x + s * rx).alias("x"), (y + s * ry).alias("y"), F.shiftright(a["d"], 2).alias("d"))

    end = F.aggregate(F.array(*[F.lit(1 << k).cast("bigint") for k in range(order)]), start, step)
    return [end["x"], end["y"]]


def hilbert(coords: Sequence[Column], order: int = 16) -> Column:
    """Curve position of a cell: itself for one axis, Hilbert for two, interleaved Gray codes for more.

    A negative index is taken ``2**order`` higher; ``order * len(coords)`` may be 63 at most.
    """
    up = [F.when(c < 0, c + F.lit(1 << order)).otherwise(c).cast("bigint") for c in coords]
    if len(up) < 2:
        return coords[0].cast("bigint")
    return hilbert2d(*up, order) if len(up) == 2 else morton([gray(c) for c in up], order)


def unhilbert(code: Column, n: int, order: int = 16) -> list[Column]:
    """The non-negative cell of a position made by :func:`hilbert`."""
    if n < 2:
        return [code]
    return unhilbert2d(code, order) if n == 2 else [ungray(c) for c in unmorton(code, n, order)]


def shard_id(coords: Sequence[Column], layout: str = "octree", size: int = 64, offset: int = 1 << 20) -> Column:
    """Shard of a cell: ``size`` consecutive positions of the Morton curve (octree, index_table) or of :func:`hilbert` (snake).

    ``flat`` spreads cells by a hash.
    """
    if layout == "flat":
        return F.xxhash64(*coords)
    if layout not in ("octree", "index_table", "snake"):
        raise ValueError(layout)
    code = hilbert(coords) if layout == "snake" else morton(coords, offset=offset)
    return F.call_function("div", code, F.lit(max(size, 1)).cast("bigint"))

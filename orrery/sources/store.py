"""A geometry store: a folder of Parquet tables and one metadata file, on any file system that Hadoop knows.

``<path>/meta.json`` holds the root metadata and its levels; ``<path>/<table>/v=<id>/`` the rows of a table, partitioned
by level.  A table's current version is named in ``meta.json``, so a rewrite (new bounds, re-sharding, compaction)
writes a new folder first and becomes visible by one small file; readers of the old version are not disturbed, and
nothing overwrites what it reads.  The versions of earlier commits are kept as snapshots until :meth:`vacuum`, and can be
opened for reading.
"""

from __future__ import annotations

import json
import uuid
import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions.grid import cell, in_box, in_box_cells, linear_fragment, morton
from orrery.operators import blocks, coarsen, parametric, polylines, rechunk, select
from orrery.plans.sizing import small, tasks_for
from orrery.plans.staging import stage
from orrery.schema import Level, Meta, StoreError, ratio

TABLES = {
    "vertices": schema.VERTICES, "links": schema.LINKS, "faces": schema.FACES, "objects": schema.OBJECTS, "groups": schema.GROUPS,
    "group_attributes": schema.GROUP_ATTRIBUTES, "parametric": schema.PARAMETRIC,
}


class GeometryStore:
    """Handle of a store; opening reads only its metadata."""

    def __init__(self, spark: SparkSession, path: str, meta: Meta, versions: dict[str, list[str]], writable: bool):
        self.spark, self.path, self.meta, self.versions, self.writable = spark, path.rstrip("/"), meta, versions, writable
        self._staged: dict[str, list[str]] = {}
        self.history: list[dict[str, Any]] = []

    # -- files

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    @classmethod
    def create(cls, spark: SparkSession, path: str, chunk_shape: Sequence[float] | None = None, bounds: tuple | None = None, **meta: Any) -> GeometryStore:
        """Create an empty store; bounds default to [0, 128] per axis, the chunk to the whole extent."""
        axes = meta.get("axes", ["x", "y", "z"])
        lo, hi = bounds or ([0.0] * len(axes), [128.0] * len(axes))
        shape = list(chunk_shape or [b - a for a, b in zip(lo, hi)])
        m = Meta(shape, list(map(float, lo)), list(map(float, hi)), **meta).check()
        fs, where = cls._fs(spark, f"{path}/meta.json")
        if fs.exists(where):
            raise StoreError(f"{path} exists")
        store = cls(spark, path, m, {}, True)
        store._save()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: str = "r", snapshot: int | None = None) -> GeometryStore:
        """Open an existing store for reading (``r``) or also writing (``r+``), or as of a snapshot, for reading only."""
        if mode not in ("r", "r+") or (snapshot is not None and mode != "r"):
            raise StoreError(mode)
        fs, where = cls._fs(spark, f"{path}/meta.json")
        if not fs.exists(where):
            raise StoreError(f"{path} is no store")
        d = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta.json", wholetext=True).collect()))  # one small file
        store = cls(spark, path, Meta.from_json(d["meta"]), d["versions"], mode == "r+")
        store.history = d.get("history", [])
        if snapshot is not None:
            found = [h for h in store.history if h["id"] == snapshot]
            if not found:
                raise StoreError(f"no snapshot {snapshot}")
            store.meta, store.versions = Meta.from_json(found[0]["meta"]), found[0]["versions"]
        return store

    @classmethod
    def create_or_open(cls, spark: SparkSession, path: str, **create: Any) -> GeometryStore:
        """Create the store if it is missing; an existing one is opened and ``create`` ignored."""
        fs, where = cls._fs(spark, f"{path}/meta.json")
        return cls.open(spark, path, "r+") if fs.exists(where) else cls.create(spark, path, **create)

    def rebind(self, path: str) -> GeometryStore:
        """The same store under another address of its folder (another scheme or mount)."""
        return GeometryStore.open(self.spark, path, "r+" if self.writable else "r")

    def _save(self, message: str = "write") -> None:
        if not self.writable:
            raise StoreError("opened for reading")
        last = self.history[-1] if self.history else {"id": 0, "versions": {}}
        if self.versions != last["versions"]:
            self.history.append({"id": last["id"] + 1, "at": time.time(), "message": message, "meta": self.meta.to_json(), "versions": dict(self.versions)})
        fs, where = self._fs(self.spark, f"{self.path}/meta.json")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps({"meta": self.meta.to_json(), "versions": self.versions, "history": self.history}).encode()))
        out.close()

    def snapshots(self) -> list[tuple[int, str]]:
        """Numbers and messages of the snapshots that can be opened."""
        return [(h["id"], h["message"]) for h in self.history]

    # -- tables

    def table(self, name: str, geometry: str | None = None, staged: bool = False) -> DataFrame:
        """Rows of a table as of the last commit (and of what is staged, if asked for); with its schema even if it is empty."""
        folders = self.versions.get(name, []) + (self._staged.get(name, []) if staged else [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[name] + (", geometry string" if geometry else ""))
        df = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/{f}" for f in folders]).drop("v")
        return df.filter(F.col("geometry") == geometry) if geometry else df

    def _write(self, name: str, df: DataFrame, cluster: bool = True) -> str:
        if not self.writable:
            raise StoreError("opened for reading")
        folder = f"v=w{uuid.uuid4().hex[:12]}"
        w = df
        if cluster and name == "vertices":
            by = ["level", "cx", "cy", "cz"]  # a rebalanced partition that holds a hot cell is split
            w = df.hint("rebalance", *by).sortWithinPartitions(*by, "oid", "seq")
        w = w.write.mode("errorifexists").option("compression", "zstd")
        (w.partitionBy("level") if "level" in df.columns else w).parquet(f"{self.path}/{name}/{folder}")
        return folder

    def stage(self, name: str, df: DataFrame) -> None:
        """Write rows that become visible with :meth:`commit`."""
        self._staged.setdefault(name, []).append(self._write(name, df))

    def commit(self, message: str = "write") -> None:
        """Make all staged rows visible at once."""
        for name, folders in self._staged.items():
            self.versions[name] = self.versions.get(name, []) + folders
        self._staged = {}
        self._save(message)

    def discard(self) -> None:
        """Forget and delete what is staged."""
        for name, folders in self._staged.items():
            for f in folders:
                fs, where = self._fs(self.spark, f"{self.path}/{name}/{f}")
                fs.delete(where, True)
        self._staged = {}

    def replace(self, name: str, df: DataFrame, cluster: bool = True) -> None:
        """Replace a table by a new version; the old files stay for readers until :meth:`vacuum`."""
        self._replace(name, df, cluster)
        self._save(f"replace {name}")

    def _replace(self, name: str, df: DataFrame, cluster: bool = True) -> None:
        self.versions[name] = [self._write(name, df, cluster)]

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that neither the store nor its last ``keep`` snapshots name; returns how many."""
        self.history, n = self.history[len(self.history) - keep :], 0
        self._save()
        for name in TABLES:
            used = {f for h in [{"versions": self.versions}, *self.history] for f in h["versions"].get(name, [])}
            fs, where = self._fs(self.spark, f"{self.path}/{name}")
            for s in fs.listStatus(where) if fs.exists(where) else []:
                if s.getPath().getName() not in used:
                    n += bool(fs.delete(s.getPath(), True))
        return n

    # -- writers

    def with_grid(self, rows: DataFrame, level: int = 0) -> DataFrame:
        """Rows with level and cell columns; a missing object, place or third axis is null."""
        shape = self.meta.level(level).chunk_shape or self.meta.chunk_shape
        have = rows
        for c, t in (("oid", "bigint"), ("seq", "bigint"), ("z", "double")):
            if c not in have.columns:
                have = have.withColumn(c, F.lit(None).cast(t))
        have = have.withColumns({c: F.col(c).cast("bigint") for c in ("vid", "oid", "seq")} | {a: F.col(a).cast("double") for a in "xyz"})
        cells = {f"c{a}": cell(F.col(a), shape[i]) if i < len(shape) else F.lit(None).cast("bigint") for i, a in enumerate("xyz")}
        have = have.withColumn("level", F.lit(level)).withColumns(cells)
        return have if "fragment" in have.columns else have.withColumn("fragment", self._fragment(level))

    def _fragment(self, level: int, bin_shape: Sequence[float] | None = None):
        """Row-major place of a vertex's bin inside its cell."""
        l = self.meta.level(level)
        size = bin_shape or l.bin_shape or self.meta.base_bin
        per = ratio(list(size), l.chunk_shape or self.meta.chunk_shape)
        return linear_fragment([cell(F.col(a), s) for a, s in zip(self.meta.axes, size)], per)

    def _bounded(self, rows: DataFrame, policy: str, allowed: Sequence[str] = schema.OUT_OF_BOUNDS) -> DataFrame:
        """Rows under an out-of-bounds policy, which ``allowed`` must hold; ``expand`` widens the bounds."""
        if policy not in allowed:
            raise StoreError(f"out_of_bounds={policy} is not allowed here")
        axes, m = self.meta.axes, self.meta
        inside = in_box(axes, m.bounds_min, m.bounds_max)
        if policy == "ignore":
            return rows.filter(inside)
        if policy == "raise":
            return rows.filter(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("vertex outside the bounds")).cast("boolean")))
        r = rows.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
        m.bounds_min = [min(b, r[2 * i]) if r[2 * i] is not None else b for i, b in enumerate(m.bounds_min)]
        m.bounds_max = [max(b, r[2 * i + 1]) if r[2 * i + 1] is not None else b for i, b in enumerate(m.bounds_max)]
        return rows

    def _stage_once(self, rows: DataFrame, policy: str, allowed: Sequence[str]) -> DataFrame:
        """Stage vertices under an out-of-bounds policy and read them back, so that the plan behind them runs once."""
        kept = rows if policy == "expand" else self._bounded(rows, policy, allowed)
        gridded = self.with_grid(kept)
        folder = self._write("vertices", gridded)
        self._staged.setdefault("vertices", []).append(folder)
        written = self.spark.read.schema(gridded.schema).parquet(f"{self.path}/vertices/{folder}")
        if policy == "expand":
            self._bounded(written, policy, allowed)
        return written

    def _typed(self, geometry: str) -> None:
        if geometry not in schema.GEOMETRY_TYPES:
            raise StoreError(geometry)
        if geometry not in self.meta.geometry_types:
            self.meta.geometry_types.append(geometry)

    def write_points(self, rows: DataFrame, out_of_bounds: str = "raise", level: int = 0) -> None:
        """Stage vertices(vid, x, y[, z, oid, seq, attributes]) under an out-of-bounds policy."""
        self.stage("vertices", self.with_grid(self._bounded(rows, out_of_bounds), level))

    def _objects(self, oids: DataFrame, level: int = 0) -> None:
        """Stage objects(oid, attributes) as present."""
        self.stage("objects", oids.withColumns({"level": F.lit(level), "oid": F.col("oid").cast("bigint"), "present": F.lit(True)}))

    def write_lines(self, lines: DataFrame, out_of_bounds: str = "raise") -> None:
        """Stage segments lines(line_id, x0, y0[, z0], x1, y1[, z1], attributes): an object of two vertices each.

        Attributes of a line are attributes of its object.  ``ignore`` is refused, since it would cut lines.
        """
        self._typed("line")
        axes = self.meta.axes
        end = lambda e: F.struct(F.lit(e).alias("seq"), *[F.col(f"{a}{e}").cast("double").alias(a) for a in axes])
        ends = lines.select(F.col("line_id").alias("oid"), F.explode(F.array(end(0), end(1))).alias("e"))
        rows = ends.select((F.col("oid") * 2 + F.col("e.seq")).alias("vid"), "oid", "e.*")
        self.stage("vertices", self.with_grid(self._bounded(rows, out_of_bounds, ("raise", "expand"))))
        self._objects(lines.drop(*[f"{a}{e}" for a in axes for e in (0, 1)]).withColumnRenamed("line_id", "oid"))

    def write_polylines(
        self, points: DataFrame, out_of_bounds: str = "raise", geometry: str = "streamline", objects: DataFrame | None = None,
        groups: DataFrame | None = None, group_attributes: DataFrame | None = None,
    ) -> None:
        """Stage ordered vertices points(vid, oid, seq, x, y[, z], attributes), every one of an object and with a place.

        ``objects`` may hold attributes by oid; without it the objects are those of the points.
        """
        if geometry not in ("polyline", "streamline"):
            raise StoreError(geometry)
        self._typed(geometry)
        whole = F.col("oid").isNotNull() & F.col("seq").isNotNull()
        rows = points.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a vertex without object or place")).cast("boolean")))
        written = self._stage_once(rows, out_of_bounds, ("raise", "expand"))
        self._objects(written.select("oid").distinct() if objects is None else objects)
        if groups is not None:
            self.write_groups(groups, group_attributes)

    def write_graph(self, nodes: DataFrame, edges: DataFrame, out_of_bounds: str = "raise", kind: str = "graph") -> None:
        """Stage nodes(vid, x, y[, z, oid, attributes]) and edges(src_vid, dst_vid[, weight, attributes]).

        Both ends of an edge must be nodes.  Edges of a ``skeleton`` run from child to parent, and a child has one parent.
        """
        if kind not in ("graph", "skeleton"):
            raise StoreError(kind)
        self._typed(kind)
        self.stage("vertices", self.with_grid(self._bounded(nodes, out_of_bounds, ("raise", "expand"))))
        if kind == "skeleton" and not edges.groupBy("src_vid").count().filter("count > 1").isEmpty():
            raise StoreError("a node of a skeleton has two parents")
        self.write_links(edges)
        if "oid" in nodes.columns:
            self._objects(nodes.filter("oid IS NOT NULL").select("oid").distinct())

    def write_mesh(self, nodes: DataFrame, faces: DataFrame, out_of_bounds: str = "raise") -> None:
        """Stage nodes(vid, x, y[, z, oid, attributes]) and faces(face_id, vids, attributes) of three or more corners."""
        self._typed("mesh")
        self.stage("vertices", self.with_grid(self._bounded(nodes, out_of_bounds, ("raise", "expand"))))
        if not faces.filter("size(vids) < 3 OR vids IS NULL").isEmpty():
            raise StoreError("a face needs three corners")
        self._known(faces.select(F.explode("vids").alias("vid")), 0)
        self.stage("faces", faces.withColumn("level", F.lit(0)))
        if "oid" in nodes.columns:
            self._objects(nodes.filter("oid IS NOT NULL").select("oid").distinct())

    def write_parametric(self, objects: DataFrame) -> None:
        """Stage objects(object_id, type_id, coefficients, name); a known type needs its number of coefficients."""
        if not parametric.check(objects).isEmpty():
            raise StoreError("wrong number of coefficients")
        self.stage("parametric", objects)

    def read_parametric(self, object_ids: Sequence[int] | None = None) -> DataFrame:
        """Objects with the names of their types; unknown types are kept."""
        p = self.table("parametric")
        return parametric.decode(p if object_ids is None else p.filter(F.col("object_id").isin(list(object_ids))))

    def _known(self, vids: DataFrame, level: int) -> None:
        have = self.table("vertices", staged=True).filter(F.col("level") == level).select("vid")
        have = have.hint("merge")  # the files are far smaller than the ids in memory, which by their size would be broadcast
        if not vids.filter("vid IS NOT NULL").distinct().join(have, "vid", "left_anti").isEmpty():
            raise StoreError(f"an end is no vertex of level {level}")

    def write_links(self, links: DataFrame, level: int = 0, delta: int = 0) -> None:
        """Stage links(src_vid, dst_vid[, link_id, weight, attributes]) from ``level`` to ``level + delta``; both ends must exist."""
        self._known(links.select(F.col("src_vid").alias("vid")), level)
        self._known(links.select(F.col("dst_vid").alias("vid")), level + delta)
        for c, t in (("link_id", "bigint"), ("weight", "double")):
            links = links.withColumn(c, F.col(c).cast(t) if c in links.columns else F.lit(None).cast(t))
        self.stage("links", links.withColumns({"level": F.lit(level), "delta": F.lit(delta)}))

    def write_groups(self, groups: DataFrame, attributes: DataFrame | None = None) -> None:
        """Stage members groups(gid, oid[, member_seq]) and attributes by gid."""
        g = groups if "member_seq" in groups.columns else groups.withColumn("member_seq", F.lit(None).cast("int"))
        self.stage("groups", g.select(F.col("gid").cast("bigint"), F.col("oid").cast("bigint"), F.col("member_seq").cast("int")))
        if attributes is not None:
            self.stage("group_attributes", attributes.withColumn("gid", F.col("gid").cast("bigint")))

    def groups(self) -> DataFrame:
        """(gid, n_members, attributes): one slot for each gid from 0 to the greatest, empty groups too."""
        g = self.table("groups")
        top = g.agg(F.max("gid")).first()[0]
        n = g.groupBy("gid").agg(F.count("*").alias("_n"))
        slots = self.spark.range(0 if top is None else top + 1).withColumnRenamed("id", "gid").join(n, "gid", "left")
        slots = slots.select("gid", F.coalesce("_n", F.lit(0)).alias("n_members"))
        return slots.join(self.table("group_attributes"), "gid", "left") if self.versions.get("group_attributes") else slots

    def write_object_attributes(self, values: DataFrame, level: int = 0) -> None:
        """Attach values(oid, attributes) to the objects of a level; objects not yet known are added as present."""
        mine = self.table("objects").filter(F.col("level") == level).drop("level", *[c for c in values.columns if c != "oid"])
        rest = self.table("objects").filter(F.col("level") != level)
        both = mine.join(values, "oid", "full").withColumns({"level": F.lit(level), "present": F.coalesce("present", F.lit(True))})
        self.replace("objects", rest.unionByName(both, allowMissingColumns=True))

    def objects(self, level: int = 0) -> DataFrame:
        """Objects of a level with ``present`` and their attributes."""
        return self.table("objects").filter(F.col("level") == level).drop("level")

    def append_vertices(self, rows: DataFrame) -> None:
        """Append vertices as new objects: given oids must exceed all present ones; without oids each vertex is an object."""
        top = self.table("vertices").agg(F.coalesce(F.max("oid"), F.lit(-1))).first()[0]
        if "oid" in rows.columns:
            low = rows.agg(F.min("oid")).first()[0]
            if low is not None and low <= top:
                raise StoreError(f"object ids must be above {top}")
        else:
            rows = blocks.number(rows.withColumn("_g", F.lit(0)), ["_g"], "vid", "_i").withColumn("oid", F.lit(top) + F.col("_i") + 1).drop("_g", "_i")
        self.stage("vertices", self.with_grid(rows))

    def add_attribute(self, name: str, values: DataFrame, on: str = "vid", table: str = "vertices") -> None:
        """Attach values(on, name) to a table by key; rows without a value get null."""
        self.replace(table, self.table(table).drop(name).join(values.select(on, name), on, "left"))

    def add_geometry(self, geometry: str, rows: DataFrame, links: DataFrame | None = None, faces: DataFrame | None = None) -> None:
        """Add a second geometry to the same store, told apart by the column ``geometry``: vertices, links and faces."""
        self._typed(geometry)
        self.stage("vertices", self.with_grid(rows).withColumn("geometry", F.lit(geometry)))
        if links is not None:
            self.write_links(links.withColumn("geometry", F.lit(geometry)))
        if faces is not None:
            self._known(faces.select(F.explode("vids").alias("vid")), 0)
            self.stage("faces", faces.withColumns({"level": F.lit(0), "geometry": F.lit(geometry)}))

    def composite(self) -> dict[str, dict[str, DataFrame]]:
        """Tables of each added geometry; rows without one belong to the first geometry of the store."""
        parts = {}
        for g in self.meta.geometry_types:
            own = {}
            for name in ("vertices", "links", "faces"):
                t = self.table(name)
                t = t if "geometry" in t.columns else t.withColumn("geometry", F.lit(None).cast("string"))
                own[name] = t.filter(F.coalesce("geometry", F.lit(self.meta.geometry_types[0])) == g).drop("geometry")
            parts[g] = own
        return parts

    # -- readers

    def points(
        self, level: int = 0, bbox: tuple | None = None, object_ids: Sequence[int] | None = None, group_ids: Sequence[int] | None = None,
        chunks: Sequence[Sequence[int]] | None = None, attributes: Sequence[str] | None = None, where: Any = None,
    ) -> DataFrame:
        """Vertices of a level under all given constraints at once.

        ``bbox`` is a closed box, pruned by cell first; ``chunks`` a list of cells ([] selects nothing, None everything);
        ``where`` any condition on attributes; ``attributes`` limits the columns.
        """
        self.meta.level(level)
        df = self.table("vertices").filter(F.col("level") == level)
        axes = self.meta.axes
        if bbox is not None:
            shape = self.meta.level(level).chunk_shape or self.meta.chunk_shape
            df = df.filter(in_box_cells([f"c{a}" for a in axes], bbox[0], bbox[1], shape)).filter(in_box(axes, bbox[0], bbox[1]))
        if object_ids is not None:
            df = df.filter(F.col("oid").isin(list(object_ids)))
        if group_ids is not None:
            df = df.join(self.group_objects(group_ids), "oid", "left_semi")
        if chunks is not None:
            if any(len(c) != len(axes) for c in chunks):
                raise StoreError("a chunk needs one index per axis")
            keys = ", ".join(f"c{a} bigint" for a in axes)
            df = df.join(self.spark.createDataFrame([tuple(c) for c in chunks], keys), [f"c{a}" for a in axes], "left_semi")
        if where is not None:
            df = df.filter(where)
        return df if attributes is None else df.select("vid", "oid", "seq", *axes, *attributes)

    def group_objects(self, group_ids: Sequence[int]) -> DataFrame:
        """Distinct members of groups; a group that does not exist is an error."""
        g = self.table("groups").filter(F.col("gid").isin(list(group_ids)))
        have = {r[0] for r in g.select("gid").distinct().collect()}  # at most the ids asked for
        if missing := set(group_ids) - have:
            raise StoreError(f"no such group {sorted(missing)}")
        return g.select("oid").distinct()

    def polylines(self, level: int = 0, **filters: Any) -> DataFrame:
        """One row per object: its positions in order."""
        p = self.points(level, **filters).filter("oid IS NOT NULL")
        at = F.sort_array(F.collect_list(F.struct("seq", "vid", *self.meta.axes)))
        return p.groupBy("oid").agg(at.alias("p")).select("oid", F.transform("p", lambda v: F.array(*[v[a] for a in self.meta.axes])).alias("positions"))

    def fragment(self, at: Sequence[int], fragment: int, level: int = 0) -> DataFrame:
        """Vertices of one fragment of a cell; one that does not exist is an error."""
        f = self.points(level, chunks=[at]).filter(F.col("fragment") == fragment)
        if f.isEmpty():
            raise StoreError(f"no fragment {fragment} in {tuple(at)}")
        return f

    def links(self, level: int = 0, delta: int = 0, chunks: Sequence[Sequence[int]] | None = None) -> DataFrame:
        """Links from ``level`` to ``level + delta``, with ``same_cell``; ``chunks`` limits the cells of their sources."""
        cells = [f"c{a}" for a in self.meta.axes]
        l = self.table("links").filter((F.col("level") == level) & (F.col("delta") == delta))
        key = lambda lv, c, n, **kw: self.points(lv, **kw).select(F.col("vid").alias(c), F.array(*cells).alias(n))
        out = l.join(key(level, "src_vid", "_a", chunks=chunks), "src_vid").join(key(level + delta, "dst_vid", "_b"), "dst_vid")
        return out.withColumn("same_cell", F.col("_a") == F.col("_b")).drop("_a", "_b")

    def read_lines(self, level: int = 0, bbox: tuple | None = None, **filters: Any) -> DataFrame:
        """(line_id, x0, .., x1, ..): with ``bbox``, the lines of which either end is in the closed box."""
        axes = self.meta.axes
        end = [F.max(F.when(F.col("seq") == e, F.col(a))).alias(f"{a}{e}") for e in (0, 1) for a in axes]
        out = self.points(level, **filters).filter("oid IS NOT NULL").groupBy(F.col("oid").alias("line_id")).agg(*end)
        if bbox is None:
            return out
        return out.filter(in_box([f"{a}0" for a in axes], *bbox) | in_box([f"{a}1" for a in axes], *bbox))

    def read_polylines(self, level: int = 0, bbox: tuple | None = None, exact: bool = True, chunks: Sequence[Sequence[int]] | None = None, **filters: Any) -> DataFrame:
        """(oid, part, positions) of polylines in order.

        ``bbox`` keeps whole polylines of which a vertex (``exact``), or a vertex's cell, meets the box; with ``chunks`` each
        maximal run of vertices inside the cells is a part of its own.
        """
        axes = self.meta.axes
        p = polylines.ordered(self.points(level, **filters).withColumn("dataset_id", F.lit(0)))
        if bbox is not None:
            shape = self.meta.level(level).chunk_shape or self.meta.chunk_shape
            p = polylines.touching(p, in_box(axes, *bbox) if exact else in_box_cells([f"c{a}" for a in axes], *bbox, shape))
        part = F.lit(0).cast("bigint")
        if chunks is not None:
            w = Window.partitionBy("oid").orderBy("ord")
            wanted = self.points(level, chunks=chunks).select("vid", F.lit(True).alias("_in"))
            p = p.join(wanted, "vid", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
            p = p.withColumn("_starts", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
            p = p.withColumn("_part", F.sum(F.col("_starts").cast("int")).over(w) - 1).filter("_in")
            part = F.col("_part")
        at = F.sort_array(F.collect_list(F.struct("ord", *axes)))
        return p.groupBy("oid", part.alias("part")).agg(at.alias("p")).select("oid", "part", F.transform("p", lambda v: F.array(*[v[a] for a in axes])).alias("positions"))

    def read_graph(self, level: int = 0, **filters: Any) -> tuple[DataFrame, DataFrame]:
        """Nodes that the filters select, with ``idx`` from 0 by vid, and the edges with both ends among them by idx."""
        nodes = blocks.number(self.points(level, **filters), ["level"], "vid", "idx")
        ids = nodes.select("vid", "idx")
        e = self.table("links").filter((F.col("level") == level) & (F.col("delta") == 0))
        e = e.join(ids.toDF("src_vid", "src_idx"), "src_vid").join(ids.toDF("dst_vid", "dst_idx"), "dst_vid")
        return nodes, e.drop("level", "delta")

    def read_mesh(self, level: int = 0, **filters: Any) -> tuple[DataFrame, DataFrame]:
        """Nodes that the filters select, with ``idx``, and the faces all of whose corners are among them, as ``corners``."""
        nodes = blocks.number(self.points(level, **filters), ["level"], "vid", "idx")
        f = self.table("faces").filter(F.col("level") == level).drop("level")
        corner = f.select("face_id", F.size("vids").alias("width"), F.posexplode("vids").alias("pos", "vid")).hint("merge").join(nodes.select("vid", "idx"), "vid")  # as in _known
        whole = corner.groupBy("face_id", "width").agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("c")).filter("size(c) = width")
        return nodes, f.hint("merge").join(whole.select("face_id", F.col("c.idx").alias("corners")), "face_id")

    def map_chunks(self, f: Any, out: str, level: int = 0, **filters: Any) -> DataFrame:
        """A user's function pandas -> pandas on each cell's vertices; a cell must fit a task."""
        return self.points(level, **filters).groupBy(*[f"c{a}" for a in self.meta.axes]).applyInPandas(f, out)

    def chunk_dim_names(self, attribute: str) -> list[str]:
        """Names of the axes of a grid led by an attribute."""
        return [attribute, *self.meta.axes]

    def chunk_keys(self, level: int = 0) -> DataFrame:
        """Sorted occupied cells of a level."""
        cells = [f"c{a}" for a in self.meta.axes]
        return self.table("vertices").filter(F.col("level") == level).select(*cells).distinct().orderBy(*cells)

    def present_oids(self, level: int = 0) -> DataFrame:
        return self.table("vertices").filter((F.col("level") == level) & F.col("oid").isNotNull()).select("oid").distinct().orderBy("oid")

    def has_object(self, oid: int, level: int = 0) -> bool:
        return bool(self.points(level, object_ids=[oid]).limit(1).count())

    # -- levels

    def levels(self) -> list[int]:
        return sorted(l.level for l in self.meta.levels)

    def ratios(self) -> dict[int, list[int]]:
        """Bin ratio of every level to the base bin; level 0 has ones."""
        return {l.level: ratio(self.meta.base_bin, l.bin_shape) if l.bin_shape else [1] * len(self.meta.axes) for l in self.meta.levels}

    def transforms(self) -> dict[int, dict[str, list[float]]]:
        """Scale (bin ratio) and translation (half a bin) of every level."""
        return {l.level: {"scale": [float(r) for r in self.ratios()[l.level]], "translation": [b / 2 for b in l.bin_shape] if l.bin_shape else [0.0] * len(self.meta.axes)} for l in self.meta.levels}

    def add_level(self, level: int, bin_ratio: Sequence[int], sparsity: float = 1.0, parent: int | None = None, chunk_scale: int = 1, method: str = "manual") -> Level:
        """Declare a level whose bins are ``bin_ratio`` base bins; it must not exist and must divide its chunk."""
        if level in self.levels():
            raise StoreError(f"level {level} exists")
        chunk = [c * chunk_scale for c in self.meta.chunk_shape] if chunk_scale != 1 else None
        l = Level(level, [b * r for b, r in zip(self.meta.base_bin, bin_ratio)], level - 1 if parent is None else parent, sparsity, chunk, method)
        self.meta.levels.append(l)
        try:
            self.meta.check()
        except StoreError:
            self.meta.levels.remove(l)
            raise
        self._save()
        return l

    def remove_level(self, level: int) -> None:
        """Drop a level and its rows; level 0 stays."""
        if level == 0:
            raise StoreError("level 0 stays")
        self.meta.levels.remove(self.meta.level(level))
        for name in ("vertices", "links", "faces", "objects"):
            if self.versions.get(name):
                rows = self.table(name).filter(F.col("level") != level)  # links from other levels into this one go too
                self._replace(name, rows.filter(F.col("level") + F.col("delta") != level) if name == "links" else rows)
        self._save(f"remove level {level}")

    def build_pyramid(
        self, factors: Sequence[int], sparsities: Sequence[float] | None = None, storage: str = "none", depth: int = 1, strategy: str = "length",
        chunk_scales: Sequence[int] | None = None, seed: int = 0,
    ) -> None:
        """Levels 1..n by :meth:`coarsen_level`, each written before the next one reads it.

        ``depth`` tells over how many levels vertices are linked with their meta vertices (-1: all, 0: none); links over
        several levels are composed of those over one.
        """
        for k, factor in enumerate(factors, 1):
            sparsity = (sparsities or [1.0] * len(factors))[k - 1]
            scale = (chunk_scales or [1] * len(factors))[k - 1]
            self.coarsen_level(k - 1, k, factor, sparsity, strategy, scale, storage if depth else "none", seed)
        far = len(factors) if depth < 0 else min(depth, len(factors))
        if storage == "none":
            return
        for d in range(2, far + 1):
            up = self.table("links").filter("delta > 0").select("level", "delta", "src_vid", "dst_vid")
            low = up.filter(F.col("delta") == d - 1).withColumn("_at", F.col("level") + d - 1)
            step = up.filter("delta = 1").select(F.col("level").alias("_at"), F.col("src_vid").alias("dst_vid"), F.col("dst_vid").alias("_top"))
            e = low.join(step, ["_at", "dst_vid"]).select("level", "src_vid", F.col("_top").alias("dst_vid"), F.lit(d).alias("delta"))
            self._stage_edges(e, storage)
            self.commit(f"links over {d} levels")

    def _stage_edges(self, up: DataFrame, storage: str) -> None:
        """Stage upward edges(level, src_vid, dst_vid, delta) and, if explicit, their mirrors."""
        e = up
        if storage == "explicit":
            back = up.select((F.col("level") + F.col("delta")).alias("level"), F.col("dst_vid").alias("src_vid"), F.col("src_vid").alias("dst_vid"), (-F.col("delta")).alias("delta"))
            e = up.unionByName(back)
        self.stage("links", e.select("level", "delta", F.lit(None).cast("bigint").alias("link_id"), "src_vid", "dst_vid", F.lit(None).cast("double").alias("weight")))

    def coarsen_level(
        self, source: int, target: int, factor: int, sparsity: float = 1.0, strategy: str = "length", chunk_scale: int = 1, storage: str = "none", seed: int = 0
    ) -> None:
        """Make level ``target`` of ``source``: one meta vertex per bin of BASE bin x factor over the surviving objects.

        Objects survive by a strategy of :func:`select.apply_sparsity`.  ``storage`` other than none adds links with delta
        +1 (and, if explicit, their mirrors).  The objects table holds the present mask.  A level whose vertices have no
        object is one implicit object 0, which survives.
        """
        self.add_level(target, [factor] * len(self.meta.axes), min(1.0, sparsity), source, chunk_scale, "per_object")
        fine = self.table("vertices").filter(F.col("level") == source)
        alone = fine.filter("oid IS NOT NULL").isEmpty()
        lines = fine.withColumn("dataset_id", F.lit(0))
        lines = lines.withColumn("oid", F.lit(0).cast("bigint")) if alone else polylines.ordered(lines)
        size = self.meta.level(target).bin_shape
        bins = {b: cell(F.col(a), size[i]) if i < len(size) else F.lit(None).cast("bigint") for i, (b, a) in enumerate(zip(coarsen.BIN, "xyz"))}
        kept = lines.select("dataset_id", "oid").distinct()
        if not alone and (sparsity < 1 or strategy == "point_thinning"):
            if strategy in ("length", "attribute"):
                kept = polylines.lengths(lines)
            elif strategy != "random":
                kept = polylines.midpoints(lines).withColumns(bins)
            kept = select.apply_sparsity(kept, sparsity, strategy, bins=coarsen.BIN, seed=seed).select("dataset_id", "oid")
        used = lines.join(kept, ["dataset_id", "oid"], "left_semi").withColumns(bins)
        meta = used.groupBy(*coarsen.BIN).agg(F.min("vid").alias("vid"), *[F.avg(a).alias(a) for a in "xyz"])
        places = coarsen.implicit_level(used) if alone else coarsen.object_level(used).drop("level", "dataset_id")
        rows = coarsen.match(places, meta, coarsen.BIN).select("vid", "x", "y", "z", "oid", F.col("place").alias("seq"))
        self.stage("vertices", self.with_grid(rows, target))
        mask = coarsen.present_mask(lines.select("dataset_id", "oid").distinct(), kept)
        self.stage("objects", mask.select(F.lit(target).alias("level"), "oid", "present"))
        if storage != "none":
            binned = fine.withColumns(bins).select("vid", *coarsen.BIN)
            e = coarsen.match(binned, meta.select(*coarsen.BIN, F.col("vid").alias("dst_vid")), coarsen.BIN)
            self._stage_edges(e.select(F.lit(source).alias("level"), F.col("vid").alias("src_vid"), "dst_vid", F.lit(target - source).alias("delta")).distinct(), storage)
        self.commit(f"level {target}")

    def coarsen_points(self, source: int, target: int, factor: int, medoid: bool = False) -> None:
        """Make level ``target`` of all vertices of ``source``, objects set aside: the mean of each bin, or its medoid."""
        self.add_level(target, [factor] * len(self.meta.axes), 1.0, source, 1, "medoid" if medoid else "mean")
        size = self.meta.level(target).bin_shape
        bins = {b: cell(F.col(a), size[i]) if i < len(size) else F.lit(None).cast("bigint") for i, (b, a) in enumerate(zip(coarsen.BIN, "xyz"))}
        fine = self.table("vertices").filter(F.col("level") == source).withColumn("dataset_id", F.lit(0)).withColumns(bins)
        if medoid:
            rows = fine.join(coarsen.medoids(fine).select("vid"), "vid", "left_semi").select("vid", "x", "y", "z")
        else:
            rows = fine.groupBy(*coarsen.BIN).agg(F.min("vid").alias("vid"), *[F.avg(a).alias(a) for a in "xyz"]).drop(*coarsen.BIN)
        self.stage("vertices", self.with_grid(rows, target))
        self.commit(f"level {target}")

    def rechunk(self, path: str, kind: str, value: str | None = None, edges: Sequence[float] | None = None) -> GeometryStore:
        """Write a store to ``path`` whose vertices have a leading index ``prefix`` by ``kind``; all rows and ids are kept.

        Objects are mapped by :func:`rechunk.map_objects`; vertices without an object have prefix -1.
        """
        new = GeometryStore.create(self.spark, path, **{k: v for k, v in self.meta.to_json().items() if k in ("chunk_shape", "bin_shape", "geometry_types", "axes", "crs")}, bounds=(self.meta.bounds_min, self.meta.bounds_max))
        new.meta.levels, new.meta.headers = list(self.meta.levels), {**self.meta.headers, "rechunk": {"kind": kind, "value": value}}
        v = self.table("vertices")
        o = v.filter("oid IS NOT NULL").select("oid").distinct().withColumn("dataset_id", F.lit(0))
        if value is not None:
            o = o.join(self.table("objects").filter("level = 0").select("oid", value), "oid", "left")
        groups = self.table("groups").withColumn("dataset_id", F.lit(0)) if self.versions.get("groups") else None
        o = small(stage(rechunk.map_objects(o, kind, groups, value, edges).select("oid", "prefix"), "prefixes"))
        tasks = tasks_for(v, 64 << 20)  # of the files: the estimate of a join is the product of its sides
        v = v.join(o, "oid", "left").withColumn("prefix", F.coalesce("prefix", F.lit(-1).cast("bigint")))
        cells = [f"c{a}" for a in self.meta.axes]
        order = ["level", "prefix", *cells, "vid"]
        folder = new._write("vertices", v.repartitionByRange(tasks, *order).sortWithinPartitions(*order), cluster=False)
        new._staged.setdefault("vertices", []).append(folder)
        for name in [n for n in self.versions if n != "vertices" and self.versions[n]]:
            new.stage(name, self.table(name))
        new.commit(f"rechunk by {kind}")
        return new

    def rebin(self, bin_shape: Sequence[float], level: int = 0) -> None:
        """Give the vertices of a level fragments by new bins, which must divide its cells; only without objects."""
        v = self.table("vertices")
        if not v.filter((F.col("level") == level) & F.col("oid").isNotNull()).isEmpty():
            raise StoreError("only levels without objects are binned anew")
        l = self.meta.level(level)
        ratio(list(bin_shape), l.chunk_shape or self.meta.chunk_shape)
        self._replace("vertices", v.withColumn("fragment", F.when(F.col("level") == level, self._fragment(level, bin_shape)).otherwise(F.col("fragment"))))
        if level:
            l.bin_shape = list(map(float, bin_shape))
        else:
            self.meta.bin_shape = list(map(float, bin_shape))
        self._save("rebin")

    # -- upkeep

    def set_bounds(self, lo: Sequence[float], hi: Sequence[float], force: bool = False) -> None:
        """Expand bounds freely; contracting needs ``force`` and prunes vertices, their links and emptied objects."""
        m = self.meta
        shrinks = any(a > b for a, b in zip(lo, m.bounds_min)) or any(a < b for a, b in zip(hi, m.bounds_max))
        if shrinks and not force:
            raise StoreError("contracting bounds needs force")
        m.bounds_min, m.bounds_max = list(map(float, lo)), list(map(float, hi))
        m.check()
        if shrinks:
            self._replace("vertices", self.table("vertices").filter(in_box(m.axes, lo, hi)))
            left = self.table("vertices").select("vid", "level").distinct()
            if self.versions.get("links"):
                l = self.table("links").join(left.toDF("src_vid", "level"), ["src_vid", "level"], "left_semi").withColumn("_to", F.col("level") + F.col("delta"))
                self._replace("links", l.join(left.toDF("dst_vid", "_to"), ["dst_vid", "_to"], "left_semi").drop("_to"))
            if self.versions.get("faces"):
                gone = self.table("faces").select("face_id", "level", F.explode("vids").alias("vid")).join(left, ["vid", "level"], "left_anti")
                self._replace("faces", self.table("faces").join(gone.select("face_id", "level").distinct(), ["face_id", "level"], "left_anti"))
            held = self.table("vertices").filter("oid IS NOT NULL").select("oid", "level").distinct()
            if self.versions.get("objects"):  # an emptied object keeps its slot
                o = self.table("objects").join(held.withColumn("_held", F.lit(True)), ["oid", "level"], "left")
                self._replace("objects", o.withColumn("present", F.col("present") & F.coalesce("_held", F.lit(False))).drop("_held"))
            if self.versions.get("groups"):
                self._replace("groups", self.table("groups").join(held.select("oid").distinct(), "oid", "left_semi"))
        self._save("bounds")

    def shard(self, files: int) -> None:
        """Cluster vertices along the Morton curve into ``files`` ranges per write, so boxes read few files."""
        v = self.table("vertices")
        cells = [F.coalesce(F.col(f"c{a}"), F.lit(0)) for a in "xyz"]
        v = v.withColumn("_m", morton(cells, offset=1 << 20)).repartitionByRange(files, "level", "_m").sortWithinPartitions("level", "_m").drop("_m")
        self.replace("vertices", v, cluster=False)

    def unshard(self) -> None:
        """Rewrite vertices by cell."""
        self.replace("vertices", self.table("vertices"))

    def shard_info(self) -> DataFrame:
        """(file, rows): what the current version consists of."""
        return self.table("vertices").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))

    def compact(self) -> None:
        """Merge all appended folders of every table into one."""
        for name in [n for n, f in self.versions.items() if len(f) > 1]:
            self.replace(name, self.table(name))

    def info(self) -> dict[str, Any]:
        """Root metadata, levels and their vertex counts."""
        n = {r[0]: r[1] for r in self.table("vertices").groupBy("level").count().collect()}  # one row a level
        return {"meta": self.meta.to_json(), "levels": self.levels(), "vertices": n, "tables": {k: len(v) for k, v in self.versions.items()}}

    def header(self, name: str, value: Any = None) -> Any:
        """Get the header of a foreign format, or set it when a value is given."""
        if value is not None:
            self.meta.headers[name] = value
            self._save()
        if name not in self.meta.headers:
            raise StoreError(f"no header {name}")
        return self.meta.headers[name]

    def remove_header(self, name: str) -> None:
        self.header(name)
        del self.meta.headers[name]
        self._save()

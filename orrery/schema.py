"""Table schemas and the grid specification of a store."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

VERTICES = "level int, vid bigint, oid bigint, seq bigint, x double, y double, z double, cx bigint, cy bigint, cz bigint, fragment bigint"
LINKS = "level int, delta int, link_id bigint, src_vid bigint, dst_vid bigint, weight double"
FACES = "level int, face_id bigint, vids array<bigint>"
OBJECTS = "level int, oid bigint, present boolean"
GROUPS = "gid bigint, oid bigint, member_seq int"
GROUP_ATTRIBUTES = "gid bigint"
PARAMETRIC = "object_id bigint, type_id int, coefficients array<double>, name string"

#: fixed values: the format's enumerations
GEOMETRY_TYPES = ("point_cloud", "line", "polyline", "streamline", "skeleton", "graph", "mesh")
OUT_OF_BOUNDS = ("raise", "ignore", "expand")
CROSS_LEVEL_STORAGE = ("none", "implicit", "explicit")
LEAST_VERSION = (0, 7, 0)


class StoreError(ValueError):
    """Invalid metadata, or a request that a store cannot serve."""


def ratio(base: list[float], other: list[float]) -> list[int]:
    """Whole per-axis ratios other / base; an error unless each is a positive integer within 1e-9."""
    if len(base) != len(other):
        raise StoreError("shapes differ in length")
    out = []
    for b, o in zip(base, other):
        r = o / b
        if round(r) < 1 or abs(r - round(r)) > 1e-9:
            raise StoreError(f"{o} is no multiple of {b}")
        out.append(round(r))
    return out


@dataclass
class Level:
    """A resolution level; level 0 has neither bin_shape nor parent, others have both."""

    level: int
    bin_shape: list[float] | None = None
    parent: int | None = None
    object_sparsity: float = 1.0
    chunk_shape: list[float] | None = None
    method: str = "manual"


@dataclass
class Meta:
    """Root metadata of a store."""

    chunk_shape: list[float]
    bounds_min: list[float]
    bounds_max: list[float]
    bin_shape: list[float] | None = None
    geometry_types: list[str] = field(default_factory=list)
    axes: list[str] = field(default_factory=lambda: ["x", "y", "z"])
    version: str = "0.8.0"
    crs: dict[str, Any] | None = None
    cross_level_storage: str = "none"
    cross_level_depth: int = 0
    levels: list[Level] = field(default_factory=lambda: [Level(0)])
    headers: dict[str, Any] = field(default_factory=dict)

    def check(self) -> Meta:
        n = len(self.axes)
        for name in ("chunk_shape", "bounds_min", "bounds_max"):
            if len(getattr(self, name)) != n:
                raise StoreError(f"{name} needs {n} entries")
        if any(s <= 0 for s in self.chunk_shape):
            raise StoreError("chunk_shape must be positive")
        if any(a > b for a, b in zip(self.bounds_min, self.bounds_max)):
            raise StoreError("bounds are upside down")
        if tuple(int(p) for p in self.version.split(".")[:3]) < LEAST_VERSION:
            raise StoreError(f"version {self.version} is too old")
        if self.cross_level_storage not in CROSS_LEVEL_STORAGE:
            raise StoreError(self.cross_level_storage)
        if bad := [g for g in self.geometry_types if g not in GEOMETRY_TYPES]:
            raise StoreError(f"unknown geometry {bad}")
        ratio(self.base_bin, self.chunk_shape)
        for l in self.levels:
            if (l.level == 0) != (l.bin_shape is None and l.parent is None) or l.level and (l.bin_shape is None or l.parent is None):
                raise StoreError("level 0 has neither bin_shape nor parent, others have both")
            if l.chunk_shape:
                ratio(self.chunk_shape, l.chunk_shape)
            if l.bin_shape:
                ratio(self.base_bin, l.bin_shape)
                ratio(l.bin_shape, l.chunk_shape or self.chunk_shape)
            if not 0 < l.object_sparsity <= 1:
                raise StoreError("sparsity must lie in (0, 1]")
        return self

    @property
    def base_bin(self) -> list[float]:
        return self.bin_shape or self.chunk_shape

    def level(self, n: int) -> Level:
        for l in self.levels:
            if l.level == n:
                return l
        raise StoreError(f"no level {n}")

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_json(d: dict[str, Any]) -> Meta:
        return Meta(**{**d, "levels": [Level(**l) for l in d["levels"]]}).check()

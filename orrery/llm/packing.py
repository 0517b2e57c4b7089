"""Filling containers of fixed capacity: hierarchical residual packing.

The tasks are the leaves of a tree.  Each packs its items best-fit, longest first, and emits the containers that are
nearly full.  Underfull containers travel on as items to the task above, where those of neighbouring tasks are packed
again: as many neighbours meet as one task holds, level by level, until one task is left.  A task never holds more than
``rows`` items: where even two neighbours hold more underfull containers, each passes on those with the most room and
emits the fuller ones.  Every container_name climbs its own tree.  Items longer than the capacity are cut into full
containers and a rest; nothing else is ever cut.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.staging import stage

ROWS = 1 << 15  #: items that one task packs
FULL = 0.99  #: containers filled to this part are emitted at once

_BIN = "container_name string, capacity int, part bigint, parts bigint, size bigint, climbs boolean, docs array<bigint>, pieces array<int>, sizes array<bigint>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each container.  Sizes are 1..capacity.

    Of the containers that an item fits into, it goes to the fullest; ties by index.  Open containers are held by
    remaining room, with one bit a room, so an item costs a few operations however many containers are open.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + ((fits & -fits).bit_length() - 1)
            b = rooms[r].pop()
            if not rooms[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > s:
            rooms[r - s].append(b)
            mask |= 1 << (r - s)
    return bins


def _packer(rows: int, full: float):
    """applyInPandas on a task of the tree: its items as containers, with those marked that climb to the task above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[d[0] for d in pdf["docs"]], piece=[p[0] for p in pdf["pieces"]]).sort_values(["first", "piece"], ignore_index=True)
        capacity, parts = int(pdf["capacity"].iloc[0]), int(pdf["parts"].iloc[0])
        docs, pieces, sizes = pdf["docs"].tolist(), pdf["pieces"].tolist(), pdf["sizes"].tolist()
        whole, out = pdf["size"].to_numpy(), []
        for b in best_fit(whole, capacity):
            out.append((
                int(whole[b].sum()), np.concatenate([docs[i] for i in b]), np.concatenate([pieces[i] for i in b]), np.concatenate([sizes[i] for i in b]),
            ))
        made = pd.DataFrame(out, columns=["size", "docs", "pieces", "sizes"])
        room = made["size"].rank(method="first")  # 1: the emptiest
        made["climbs"] = (made["size"] < full * capacity) & (room <= max(1, rows // 2)) & (parts > 1)
        for name in ("part", "parts", "capacity", "container_name"):
            made[name] = pdf[name].iloc[0]
        return made[["container_name", "capacity", "part", "parts", "size", "climbs", "docs", "pieces", "sizes"]]

    return run


def pack(items: DataFrame, containers: DataFrame, rows: int = ROWS, full: float = FULL) -> DataFrame:
    """(container_name, container_id, doc_id, piece, n_tokens): the containers of items(doc_id, n).

    Every doc_id is placed once for each row of containers(container_name, capacity); one longer than the capacity has
    several pieces, all but the last of which fill a container.  Items of size 0 join an existing container (or one of
    their own if there is no other).  Null sizes count as 0; container rows with a null or non-positive capacity are
    left out; container_id is unique within a container_name.  Empty tables give no rows.
    """
    caps = F.broadcast(containers.filter("capacity > 0").select("container_name", "capacity").distinct())  # a fixed table
    n = items.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    every = stage(n.join(caps), "items")  # a row per item and capacity
    whole = F.floor(F.col("n") / F.col("capacity")).cast("int")
    rest = F.col("n") % F.col("capacity")
    cut = every.filter("n >= capacity").select(
        "container_name", F.col("capacity").cast("bigint").alias("n_tokens"), "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")
    ).select("container_name", F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "n_tokens")
    open_ = every.filter(rest > 0).select(
        "container_name", F.col("capacity").cast("int").alias("capacity"), rest.alias("size"), F.array("doc_id").alias("docs"),
        F.array(whole).alias("pieces"), F.array(rest).alias("sizes"),
    )
    leaves = every.filter(rest > 0).groupBy("container_name").agg(F.ceil(F.count("*") / F.lit(rows)).cast("bigint").alias("parts"))  # one row a container_name
    part = F.pmod(F.xxhash64(F.element_at("docs", 1), F.element_at("pieces", 1)), F.col("parts"))
    level = open_.join(F.broadcast(leaves), "container_name").withColumn("part", part)
    tree, closed = ["container_name", "capacity", "part", "parts"], []
    while True:
        made = stage(level.groupBy(*tree).applyInPandas(_packer(rows, full), _BIN), "bins")
        closed.append(made.filter("NOT climbs"))
        up = made.filter("climbs")
        fullest = up.groupBy("container_name", "part").agg(F.count("*").alias("n")).groupBy("container_name").agg(F.max("n").alias("n"))
        if not (most := {r[0]: r[1] for r in fullest.collect()}):  # one row a container_name
            break
        meet = reduce(lambda a, r: F.when(F.col("container_name").eqNullSafe(F.lit(r[0])), F.lit(max(2, rows // r[1]))).otherwise(a), most.items(), F.lit(2))
        level = up.withColumns({"part": F.floor(F.col("part") / meet).cast("bigint"), "parts": F.ceil(F.col("parts") / meet).cast("bigint")}).drop("climbs")
    out = cut
    for k, made in enumerate(closed):
        name = F.concat_ws("-", F.lit(f"r{k}"), F.element_at("docs", 1), F.element_at("pieces", 1))
        flat = made.select("container_name", name.alias("container_id"), F.explode(F.arrays_zip("docs", "pieces", "sizes")).alias("m"))
        out = out.unionByName(flat.select(
            "container_name", "container_id", F.col("m.docs").alias("doc_id"), F.col("m.pieces").alias("piece"), F.col("m.sizes").alias("n_tokens")
        ))
    first = out.groupBy("container_name").agg(F.min("container_id").alias("container_id"))  # one row a capacity
    none = every.filter("n = 0").join(F.broadcast(first), "container_name", "left").select(
        "container_name", F.coalesce("container_id", F.lit("empty")).alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("n_tokens")
    )
    return out.unionByName(none)


def flaws(packed: DataFrame, items: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container_name: documents placed, containers over their capacity, documents cut although they fit, documents
    whose pieces do not sum to their size, and whether at most a fiftieth (and one container) is used above the least.
    """
    caps = containers.filter("capacity > 0").select("container_name", "capacity").distinct()
    used = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t")).join(caps, "container_name")
    used = used.groupBy("container_name").agg(
        F.count_if(F.col("t") > F.col("capacity")).alias("n_over"), F.count("*").alias("_n"), F.ceil(F.sum("t") / F.max("capacity")).alias("_least")
    )
    docs = packed.groupBy("container_name", "doc_id").agg(F.count("*").alias("p"), F.sum("n_tokens").alias("t")).join(caps, "container_name")
    docs = docs.join(items.select("doc_id", F.coalesce("n", F.lit(0)).alias("n")), "doc_id", "full").groupBy("container_name").agg(
        F.count("doc_id").alias("n_docs"), F.count_if((F.col("p") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_cut"),
        F.count_if(~F.col("t").eqNullSafe(F.col("n"))).alias("n_lost"),
    )
    near = (F.col("_n") <= F.ceil(F.col("_least") * 1.02) + 1).alias("near_least")
    return docs.join(used, "container_name", "left").select("container_name", "n_docs", "n_over", "n_cut", "n_lost", near)


def summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container_name: containers used, tokens, the fewest containers possible for them, and the part left unused."""
    caps = containers.filter("capacity > 0").select("container_name", "capacity").distinct()
    per = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    per = per.groupBy("container_name").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens")).join(caps, "container_name")
    return per.select(
        "container_name", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
        (F.lit(1.0) - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused"),
    )

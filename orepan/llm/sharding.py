"""Shards of near-equal size by a k-d tree over document metadata.

Documents with equal texts form one point with their summed size, and stay together.  Groups above an eighth
of a shard would leave no even cut, so they are placed first, largest first, each into the shard with most
room.  Only a group for which no shard has room enough is dealt over several, by a hash of the id: such
a group exceeds what a shard may hold beside the groups before it.

The k-d tree then places all other points into the room that is left.  A node that stands for several shards
is split along its widest dimension (extent over the extent of all points) at the weighted quantile at which
the left half's room is of both halves' room (a median where it is even), until each leaf is one shard.  The
quantile is found by all points together: histograms of 2^12 bins over the points' ordered coordinate narrow
the cut down, bits at a time, until its bin is lighter than the tolerance.  All nodes of a level are
treated at once by joins with the table of open nodes; the driver holds one row a node, never points or bins.

Dimensions: size, number of lines, language and source (by hash, so that a language or source stays together).

Null texts have size ``overhead`` and are one group of their own; null metadata counts as "".  Repeated
rows are rows of their own.  Rows with null ids are placed like others.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

BINS = 12  # bits per histogram
WIDTH = 20  # bits of a dimension's place; the rest of a coordinate breaks ties by hash
TIES = 28
SALT = 1 << 20  # hash places of the rows of a dealt group


def text_size(text: str, overhead: int = 8) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def deal_heavy(groups: list[tuple[int, int]], shards: int, target: float, slack: float = 0.01) -> tuple[list[tuple], list[float]]:
    """Parts ``(g, lo, hi, shard)`` of the groups ``(g, weight)``, and each shard's load; lo and hi are hash places."""
    load, out = [(0.0, s) for s in range(shards)], []
    for g, w in sorted(groups, key=lambda x: (-x[1], x[0])):
        left, lo = float(w), 0
        while left > 0:
            used, s = load[0]
            room = target - used
            part = left if left <= room + slack * target else max(room, slack * target)
            left -= part
            hi = SALT if left <= 0 else round(SALT * (1 - left / w))
            heapq.heapreplace(load, (used + part, s))
            if hi > lo:
                out.append((g, lo, hi, s))
            lo = hi
    return out, [used for used, _ in sorted(load, key=lambda x: x[1])]


def kd_leaves(points: DataFrame, room: list[float], tolerance: float = 0.002) -> DataFrame:
    """``p, leaf`` of ``points`` (``p, w, d0..``): the number of the shard, each of which has its ``room``."""
    spark, dims = points.sparkSession, [c for c in points.columns if c.startswith("d")]
    span = points.agg(*(F.min(d) for d in dims), *(F.max(d) for d in dims), F.sum("w")).first()
    k = len(dims)
    if span[2 * k] is None:
        return points.select("p", F.lit(0).alias("leaf"))
    low, extent = span[:k], [max(span[k + i] - span[i], 0.0) for i in range(k)]
    # place in [0, 2^WIDTH) and a hash below it: an order of its own for every point
    ties = F.pmod(F.xxhash64("p", F.lit("ties")), F.lit(1 << TIES))
    at = [((F.floor((F.col(d) - low[i]) / (extent[i] or 1.0) * ((1 << WIDTH) - 1)).cast("long") * (1 << TIES)) + ties).alias(d) for i, d in enumerate(dims)]
    now = written(points.select("p", "w", *at, F.lit(0).alias("node")), "kd-points")
    below = [0.0]
    for r in room:
        below.append(below[-1] + max(r, 0.0))
    nodes, open_nodes, following = {0: (0, len(room))}, [0] if len(room) > 1 else [], 1  # node -> first shard, shards
    leaf = {0: 0}

    def coordinate() -> Column:
        """The node's dimension of a point."""
        return F.coalesce(*(F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)))

    while open_nodes:
        asked = F.broadcast(spark.createDataFrame([(n,) for n in open_nodes], "node int"))
        seen = now.join(asked, "node").groupBy("node").agg(F.sum("w").alias("w"), *(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).collect()
        state = {}
        for r in seen:  # a node without points has no row: its shards stay empty
            first, s = nodes[r.node]
            d = max(range(k), key=lambda i: ((r[f"hi_d{i}"] - r[f"lo_d{i}"]) >> TIES, -i))
            mid, all_room = below[first + s // 2] - below[first], below[first + s] - below[first]
            share = mid / all_room if all_room > 0 else (s // 2) / s
            # cut: smallest coordinate whose weight below is at least `want`; narrowed from the top bits down
            state[r.node] = {"d": d, "want": r.w * share, "base": 0, "below": 0.0, "slack": tolerance * r.w / s, "cut": None}
        shift = WIDTH + TIES
        while todo := {n: x for n, x in state.items() if x["cut"] is None}:
            shift = max(shift - BINS, 0)
            look = F.broadcast(spark.createDataFrame([(n, x["d"], x["base"], x["want"] - x["below"]) for n, x in todo.items()], "node int, dim int, base long, want double"))
            value = coordinate() - F.col("base")
            bins = now.join(look, "node").where((value >= 0) & (value < (1 << min(shift + BINS, WIDTH + TIES)))).groupBy("node", "want", F.shiftright(value, shift).alias("bin")).agg(F.sum("w").alias("w"))
            upto = F.sum("w").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
            picked = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("want")).groupBy("node").agg(F.min(F.struct("bin", "w", "upto")).alias("b"))
            found = {r.node: r.b for r in picked.collect()}
            for n, x in todo.items():
                if n not in found:
                    x["cut"] = 1 << (WIDTH + TIES)
                    continue
                b, w, total = found[n]
                want = x["want"] - x["below"]
                if shift and w > x["slack"]:  # the bin is looked into
                    x["base"], x["below"] = x["base"] + (b << shift), x["below"] + total - w
                else:  # either border is near enough
                    x["cut"] = x["base"] + ((b + (total - want < want - (total - w))) << shift)
        splits, open_nodes = [], []
        for n, x in state.items():
            first, s = nodes[n]
            splits.append((n, x["d"], x["cut"], following))
            for child, part in ((following, (first, s // 2)), (following + 1, (first + s // 2, s - s // 2))):
                nodes[child], leaf[child] = part, part[0]
                if part[1] > 1:
                    open_nodes.append(child)
            following += 2
        moved = now.join(F.broadcast(spark.createDataFrame(splits, "node int, dim int, cut long, child int")), "node", "left")
        node = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("child") + (coordinate() >= F.col("cut")).cast("int"))
        now = written(moved.select("p", "w", *dims, node.alias("node")), "kd-points")
    # one row a node: fewer than twice the shards
    return now.join(F.broadcast(spark.createDataFrame(sorted(leaf.items()), "node int, leaf int")), "node").select("p", "leaf")


def _keyed(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> dict[str, Column]:
    """What a row's shard and slot depend on: its group, its hash place in it, its size and its order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "__id": F.col(id_col).cast("long"),
        "__size": text_size(text_col, overhead),
        "__crc": F.crc32(text.cast("binary")),
        "__g": F.xxhash64(F.col(text_col).isNull(), text),
        "__at": F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("part")), F.lit(SALT)).cast("int"),
        "__bin": F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.crc32(text.cast("binary"))), F.lit(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))).cast("int"),
    }


def _places(rows: DataFrame, shards: int | None, target_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    """Where groups go: heavy parts (``__g, lo, hi, shard``) and all other groups (``__g, leaf``)."""
    merged = written(rows.groupBy("__g").agg(F.sum("__size").alias("w"), F.max("__size").alias("size"), F.max("__lines").alias("lines"), F.min("__lang").alias("lang"), F.min("__source").alias("source")), "shard-groups")
    total = merged.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    n = shards or max(1, -(-total // (target_bytes or 1 << 30)))
    heavy = F.col("w") * 8 * n > total
    # fewer than 8 n groups can weigh more than an eighth of a shard each
    parts, load = deal_heavy([(r["__g"], r.w) for r in merged.where(heavy).select("__g", "w").collect()] if n > 1 else [], n, total / n)
    parts = _even(rows, parts)
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)
    points = (merged.where(~heavy) if n > 1 else merged).select(F.col("__g").alias("p"), "w", F.log2("size").alias("d0"), F.log2(F.col("lines") + 1).alias("d1"), hashed("lang").alias("d2"), hashed("source").alias("d3"))
    leaves = kd_leaves(points, [total / n - x for x in load])
    return rows.sparkSession.createDataFrame(parts, "__g long, lo int, hi int, dealt int"), leaves.select(F.col("p").alias("__g"), "leaf")


def _even(rows: DataFrame, parts: list[tuple], bits: int = 8) -> list[tuple]:
    """The borders of dealt groups moved to where their rows' weights are split as meant: hash places of few rows are uneven."""
    dealt = [(g, hi) for g, _, hi, _ in parts if hi < SALT]
    if not dealt:
        return parts
    asked = F.broadcast(rows.sparkSession.createDataFrame(dealt, "__g long, hi int"))
    some = rows.join(asked.select("__g").distinct(), "__g", "left_semi").groupBy("__g", F.shiftright("__at", bits).alias("bin")).agg(F.sum("__size").alias("w"))
    own = W.partitionBy("__g")
    upto = some.withColumns({"upto": F.sum("w").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("w").over(own)})
    found = upto.join(asked, "__g").where(F.col("upto") * SALT >= F.col("hi") * F.col("all")).groupBy("__g", "hi").agg(F.min("bin").alias("bin")).collect()
    moved = {(r["__g"], r.hi): (r.bin + 1) << bits for r in found} | {(g, end): end for g, *_ in parts for end in (0, SALT)}
    return [(g, moved[g, lo], moved[g, hi], s) for g, lo, hi, s in parts]


def _assigned(rows: DataFrame, heavy: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with ``__shard``; rows of heavy groups are not shuffled, and no other group is large."""
    part = heavy.withColumnRenamed("__g", "__h")
    marked = rows.join(F.broadcast(part), (F.col("__g") == F.col("__h")) & (F.col("__at") >= F.col("lo")) & (F.col("__at") < F.col("hi")), "left").drop("__h", "lo", "hi")
    rest = marked.where("dealt is null").drop("dealt").join(leaves.hint("merge"), "__g").withColumnRenamed("leaf", "__shard")
    return marked.where("dealt is not null").withColumnRenamed("dealt", "__shard").unionByName(rest)


def _metadata(docs: DataFrame, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return {"__lines": lines, **{f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source")}}


def shard(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row: shards of near-equal bytes, copies together.

    Give the number of shards, or the bytes each should hold.
    """
    rows = written(docs.select(*(v.alias(c) for c, v in {**_keyed(docs, id_col, text_col, overhead), **_metadata(docs, text_col)}.items())), "shard-rows")
    placed = written(_assigned(rows.drop("__lines", "__lang", "__source"), *_places(rows, shards, target_bytes)), "shard-placed")
    # slots: counts per (shard, hash bin) give each bin its first slot; inside a bin rows are numbered
    sums = placed.groupBy("__shard", "__bin").agg(F.count("*").alias("c"))
    first = sums.select("__shard", "__bin", (F.sum("c").over(W.partitionBy("__shard").orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    numbered = placed.withColumn("rn", F.row_number().over(W.partitionBy("__shard", "__bin").orderBy("__id", "__crc")))
    # one row per shard and bin, joined where the numbered rows lie already
    slots = numbered.join(first, ["__shard", "__bin"])
    return slots.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), (F.col("before") + F.col("rn") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> None:
    """Write every row of ``docs`` once, one folder per shard (``shard=N``), its files and their rows in slot order.

    Rows go where their text and id send them, so null and repeated ids are written like all others.  If the
    input has a column ``shard`` the folders are named ``__shard=N``.
    """
    keyed = docs.withColumns(_keyed(docs, id_col, text_col, overhead))
    slim = written(keyed.select(*_keyed(docs, id_col, text_col, overhead), *(v.alias(c) for c, v in _metadata(docs, text_col).items())), "shard-rows")
    name, order = "__shard" if "shard" in docs.columns else "shard", ("__shard", "__bin", "__id", "__crc")
    rows = _assigned(keyed, *_places(slim, shards, target_bytes)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(*docs.columns, F.col("__shard").alias(name)).write.partitionBy(name).parquet(path)

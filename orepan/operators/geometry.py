"""Tolerant search over labelled 3-D points, and counts and distances on point tables.

Point objects are rows ``object_id, conformer_id, features`` with ``features`` an
``array<struct<type string, position array<double>>>``.  Searching compares triangles: three points,
keyed by their sorted types, with sorted edge lengths in bins.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values of the published search.
BIN_WIDTH, TOLERANCE, MOST_TRIANGLES, SHORTEST_EDGE = 0.5, 1.0, 64, 1e-8


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two ``array<double>`` positions; null where a part is missing."""
    return F.sqrt(sum(((F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in (1, 2)), (F.get(a, F.lit(0)) - F.get(b, F.lit(0))) * (F.get(a, F.lit(0)) - F.get(b, F.lit(0)))))


def toward(position: tuple[Column, Column, Column], center: tuple[Column, Column, Column], step: float = 2.8) -> tuple[Column, Column, Column]:
    """The position moved toward the centre by ``step``, or half way if that is nearer; a position at the centre stays."""
    way = [c - p for p, c in zip(position, center)]
    norm = F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
    far = F.least(F.lit(step), norm * 0.5)
    return tuple(F.when(norm <= SHORTEST_EDGE, p).otherwise(p + far * w / norm) for p, w in zip(position, way))


#: The three pairs of a triangle's points.
PAIRS = ((0, 1), (0, 2), (1, 2))


def _shifted(steps: Column, name: str) -> Column:
    return F.transform(steps, lambda d: F.col(name) + d)


def _length(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """As ``distance``, of points given as three columns each."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:])), (p[0] - q[0]) * (p[0] - q[0])))


def _area(p: tuple[Column, ...], q: tuple[Column, ...], r: tuple[Column, ...]) -> Column:
    a, b = [y - x for x, y in zip(p, q)], [y - x for x, y in zip(p, r)]
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    return 0.5 * F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])


def triangles(objects: DataFrame, *, features: str = "features", keep: tuple[str, ...] = ("object_id", "conformer_id")) -> DataFrame:
    """All point triples of each object (degenerate ones out), built row by row without a shuffle.

    Gives ``i, j, k, type_key, kinds`` (distinct types)``, edges`` (sorted)``, area, perimeter``, and of the points
    in order the types ``t0, t1, t2`` and the distances ``d01, d02, d12``, all as plain columns.
    """
    n, held = F.size(features), "__points"
    flat = F.transform(features, lambda p, at: F.struct(at.alias("at"), p["type"].alias("type"), *(F.get(p["position"], F.lit(x)).alias(c) for x, c in enumerate("xyz"))))
    names = [(o, f"t{x}", f"x{x}", f"y{x}", f"z{x}") for x, o in enumerate("ijk")]
    at = [tuple(F.col(c) for c in of[2:]) for of in names]
    # each point comes out of its generator as plain columns, and a distance is made as soon as its points are there:
    # the generated code stays under the size above which the JVM no longer compiles it
    rows = objects.where(n >= 3).select(*keep, flat.alias(held))
    rows = rows.select("*", F.inline(F.slice(held, F.lit(1), F.size(held) - 2)).alias(*names[0]))
    rows = rows.select("*", F.inline(F.slice(held, F.col("i") + 2, F.size(held) - 2 - F.col("i"))).alias(*names[1])).withColumn("d01", _length(at[0], at[1]))
    rows = rows.select("*", F.inline(F.slice(held, F.col("j") + 2, F.size(held) - 1 - F.col("j"))).alias(*names[2]))
    rows = rows.select(*keep, "i", "j", "k", "t0", "t1", "t2", "d01", _length(at[0], at[2]).alias("d02"), _length(at[1], at[2]).alias("d12"), _area(*at).alias("area"))
    return completed(rows).where(F.get("edges", F.lit(0)) > SHORTEST_EDGE)


def completed(tri: DataFrame) -> DataFrame:
    """``tri`` with what follows from its types and distances, ``edges, type_key, kinds, perimeter``, if it lacks them."""
    if "edges" in tri.columns:
        return tri
    a, b, c = (F.col(f"d{x}{y}") for x, y in PAIRS)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    types = F.array("t0", "t1", "t2")
    out = tri.withColumns({"edges": F.array(F.least(a, b, c), middle, F.greatest(a, b, c)), "type_key": F.array_join(F.sort_array(types), "|"), "kinds": F.size(F.array_distinct(types))})
    return out.withColumn("perimeter", F.get("edges", F.lit(0)) + F.get("edges", F.lit(1)) + F.get("edges", F.lit(2)))


def binned(tri: DataFrame, width: float = BIN_WIDTH) -> DataFrame:
    """Adds ``b0, b1, b2``, the bins of the sorted edges, and ``cell``, the types with the first bin: the look-up key."""
    out = tri.withColumns({f"b{x}": F.floor(F.get("edges", F.lit(x)) / width).cast("int") for x in range(3)})
    return out.withColumn("cell", _cell(F.col("type_key"), F.col("b0")))


def _cell(type_key: Column, b0: Column) -> Column:
    return F.concat_ws("#", type_key, b0.cast("string"))


def _reach(tolerance: float, width: float) -> int:
    """Bins on either side that an edge within the tolerance can lie in."""
    return int(-(-tolerance // width)) + 1


def select_query_triangles(tri: DataFrame, most: int = MOST_TRIANGLES, keep: tuple[str, ...] = ("object_id", "conformer_id")) -> DataFrame:
    """The most telling triangles of each query: more types, larger area, longer perimeter, smaller indices."""
    order = W.partitionBy(*keep).orderBy(F.desc("kinds"), F.desc("area"), F.desc("perimeter"), "i", "j", "k")
    return completed(tri).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def match_triangles(index: DataFrame, query: DataFrame, *, tolerance: float = TOLERANCE, width: float = BIN_WIDTH, candidates: DataFrame | None = None) -> DataFrame:
    """Best correspondence of each query triangle with each indexed triangle.

    The query side (at most ``MOST_TRIANGLES`` rows of one query) is spread over the first bins that the tolerance can
    reach, so the look-up is a hash join on the cell; its rows have a fixed bound and are broadcast.  Sorted edges
    that differ by more than the tolerance are then out by plain comparisons, and only for what is left the six
    permutations are tried.  ``candidates`` restricts the objects: it is joined to what matches, not to the index.
    """
    around = F.sequence(F.lit(-_reach(tolerance, width)), F.lit(_reach(tolerance, width)))
    q = binned(completed(query), width).select(F.struct("i", "j", "k").alias("q"), *(F.col(x).alias(f"q{x}") for x in ("t0", "t1", "t2", "d01", "d02", "d12", "edges")), "type_key", F.explode(_shifted(around, "b0")).alias("b0"))
    q = q.withColumn("cell", _cell(F.col("type_key"), F.col("b0"))).drop("type_key", "b0")
    near = F.lit(True)
    for x in range(3):
        near = near & (F.abs(F.get("edges", F.lit(x)) - F.get("qedges", F.lit(x))) <= tolerance * (1 + 1e-9))
    met = completed(index).join(F.broadcast(q), "cell").where(near)
    own, tries = (F.col("i"), F.col("j"), F.col("k")), []
    for perm in permutations(range(3)):
        errors = [F.abs(F.col(f"qd{a}{b}") - F.col("d{}{}".format(*sorted((perm[a], perm[b]))))) / tolerance for a, b in PAIRS]
        same = (F.col("qt0") == F.col(f"t{perm[0]}")) & (F.col("qt1") == F.col(f"t{perm[1]}")) & (F.col("qt2") == F.col(f"t{perm[2]}"))
        fits = same & (F.greatest(*errors) <= 1.0 + 1e-12)
        middle = F.greatest(F.least(errors[0], errors[1]), F.least(F.greatest(errors[0], errors[1]), errors[2]))
        best = F.struct(middle.alias("error"), ((errors[0] + errors[1] + errors[2]) / 3).alias("mean"), F.array(*(F.lit(x) for x in perm)).alias("perm"), F.array(*(own[x] for x in perm)).alias("c"))
        tries.append(F.when(fits, best))
    # array_min passes over the nulls of what does not fit
    out = met.withColumn("best", F.array_min(F.array(*tries))).where("best is not null").select("object_id", "conformer_id", "q", F.col("best.error").alias("error"), F.col("best.c").alias("c"))
    return out if candidates is None else out.join(candidates, "object_id", "left_semi")


def match_published(index: DataFrame, query: DataFrame, *, tolerance: float = TOLERANCE, width: float = BIN_WIDTH, candidates: DataFrame | None = None) -> DataFrame:
    """``match_triangles`` over a published index, of which only the buckets of the query's cells are read.

    The query's triangles (at most ``MOST_TRIANGLES`` of one query) come to the driver, as a filter needs their cells as
    literals.  The index is neither sorted nor shuffled.
    """
    columns = ["i", "j", "k", "t0", "t1", "t2", "d01", "d02", "d12", "edges", "type_key", "b0"]
    query = binned(completed(query), width)
    rows = query.select(*columns).collect()
    if len(rows) > MOST_TRIANGLES:
        raise ValueError(f"one query has at most {MOST_TRIANGLES} triangles: select them first")
    reach = _reach(tolerance, width)
    cells = sorted({f"{r.type_key}#{r.b0 + d}" for r in rows for d in range(-reach, reach + 1)})
    small = index.sparkSession.createDataFrame(rows, query.select(*columns).schema)
    return match_triangles(index.where(F.col("cell").isin(cells)), small, tolerance=tolerance, width=width, candidates=candidates)


def best_matches(matches: DataFrame) -> DataFrame:
    """Per conformer and query triangle the match of smallest (error, candidate indices)."""
    best = matches.groupBy("object_id", "conformer_id", "q").agg(F.min(F.struct("error", "c")).alias("m"))
    return best.select("object_id", "conformer_id", "q", F.col("m.error").alias("error"), F.col("m.c").alias("c"))


def hits(best: DataFrame, query_points: int) -> DataFrame:
    """Coverage, median error and score per conformer."""
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("q.i", "q.j", "q.k")))))
    out = best.groupBy("object_id", "conformer_id").agg((covered / float(query_points)).alias("coverage"), F.median("error").alias("median_error"), F.count("*").alias("matches"))
    return out.withColumn("score", F.col("coverage") / (1 + F.col("median_error")))


def top_objects(conformer_hits: DataFrame, k: int = 512) -> DataFrame:
    """Best conformer per object, then the first ``k`` objects, ranked; ties end in the id."""
    own = W.partitionBy("object_id").orderBy(F.desc("coverage"), "median_error", "conformer_id")
    best = conformer_hits.withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn")
    return ranked(best, ["coverage desc", "median_error", "object_id"], k)


def ranked(df: DataFrame, order: list[str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank.  Only those k rows meet in one task."""
    keys = [F.desc(x.removesuffix(" desc")) if x.endswith(" desc") else F.col(x) for x in order]
    return df.orderBy(*keys).limit(k).withColumn(name, F.row_number().over(W.orderBy(*keys)))


def match_masks(best: DataFrame, query_numbers: DataFrame) -> DataFrame:
    """Bit mask of the matched query triangles per object, and the least error over them."""
    return best.join(F.broadcast(query_numbers), "q").groupBy("object_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number"))).alias("mask"), F.min("error").alias("min_error"))


def in_box(center: tuple[float, float, float], size: tuple[float, float, float], slack: float = 0.0) -> Column:
    """Whether the point (x, y, z) lies in the box, borders included."""
    test = F.lit(True)
    for c, m, s in zip("xyz", center, size):
        test = test & (F.abs(F.col(c) - m) <= s / 2 + slack)
    return test


def plausible_box(size: tuple[str, str, str], low: float = 4.0, high: float = 60.0, volume: float = 27_000.0) -> Column:
    """Whether a box has finite sides within limits and no more than the largest volume."""
    sides = [F.col(c) for c in size]
    fits = F.lit(True)
    for s in sides:
        fits = fits & ~F.isnan(s) & s.between(low, high)
    return F.coalesce(fits & (sides[0] * sides[1] * sides[2] <= volume), F.lit(False))


def box_overlap(points: DataFrame, center: tuple, size: tuple, by: str = "structure_id") -> DataFrame:
    """Per structure: points, points in the box, and the smallest distance to its centre."""
    d = F.sqrt(sum(((F.col(c) - m) * (F.col(c) - m) for c, m in zip("xyz", center)), F.lit(0.0)))
    return points.groupBy(by).agg(F.count("*").alias("points"), F.count_if(in_box(center, size)).alias("inside"), F.round(F.min(d), 6).alias("nearest"), F.round(F.min(F.when(F.col("het"), d)), 6).alias("nearest_het"))


def bounding_box(points: DataFrame, by: str = "structure_id", padding: float = 5.0) -> DataFrame:
    """Centre and padded size of each structure's points."""
    return points.groupBy(by).agg(*((((F.min(c) + F.max(c)) / 2).alias(f"center_{c}")) for c in "xyz"), *((F.max(c) - F.min(c) + 2 * padding).alias(f"size_{c}") for c in "xyz"))


def contacts(left: DataFrame, right: DataFrame, radius: float, by: str = "structure_id") -> DataFrame:
    """Pairs within ``radius``: ``left`` is spread over the 27 cells around it, then a hash join on the cell.

    Both sides hold ``by, id, x, y, z``; the result has ``left_id, right_id, distance``.
    """
    cell = {f"g{c}": F.floor(F.col(c) / radius).cast("long") for c in "xyz"}
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    a = left.select(by, F.col("id").alias("left_id"), *(F.col(c).alias(f"l{c}") for c in "xyz"), *(v.alias(k) for k, v in cell.items()))
    for c in "xyz":
        a = a.withColumn(f"g{c}", F.explode(_shifted(around, f"g{c}")))
    b = right.select(by, F.col("id").alias("right_id"), *(F.col(c).alias(f"r{c}") for c in "xyz"), *(v.alias(k) for k, v in cell.items()))
    d = F.sqrt(sum(((F.col(f"l{c}") - F.col(f"r{c}")) * (F.col(f"l{c}") - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0)))
    return a.join(b, [by, "gx", "gy", "gz"]).withColumn("distance", d).where(F.col("distance") <= radius).select(by, "left_id", "right_id", "distance")


def crop_residues(atoms: DataFrame, pose: DataFrame, cutoff: float = 8.0, by: str = "structure_id", *, most: int = 2000) -> DataFrame:
    """All atoms of residues with an atom within ``cutoff`` of the pose (``by, x, y, z``; several poses count together).

    Atoms are shuffled once, by structure: they meet the pose's points as one array, and a residue's atoms lie beside each
    other then.  Structures whose pose has more than ``most`` points go by cells (``contacts``) instead.
    """
    sizes = pose.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select("of")
    some = not large.isEmpty()
    few = pose.join(large, F.col(by) == F.col("of"), "left_anti") if some else pose
    points = few.groupBy(F.col(by).alias("of")).agg(F.collect_list(F.struct("x", "y", "z")).alias("pose"))
    heavy = ~F.coalesce(F.col("hydrogen"), F.lit(False)) if "hydrogen" in atoms.columns else F.lit(True)
    square = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "xyz"), F.lit(0.0))
    near = heavy & F.coalesce(F.exists("pose", lambda p: F.sqrt(square(p)) <= cutoff), F.lit(False))
    met = atoms.join(points, F.col(by) == F.col("of")).withColumn("near", near)
    out = met.withColumn("near", F.max("near").over(W.partitionBy("of", "residue"))).where("near").select(*atoms.columns)
    if not some:
        return out
    own = atoms.join(large, F.col(by) == F.col("of"), "left_semi")
    close = contacts(pose.join(large, F.col(by) == F.col("of"), "left_semi"), own.where(heavy), cutoff, by).select(by, F.col("right_id").alias("id")).distinct()
    residues = own.join(close, [by, "id"], "left_semi").select(by, "residue").distinct()
    return out.unionByName(own.join(residues, [by, "residue"], "left_semi").select(*atoms.columns))


def ring_centroids(atoms: DataFrame, by: tuple[str, ...] = ("structure_id", "residue"), least: int = 3) -> DataFrame:
    """Mean position of each group with at least ``least`` points."""
    return atoms.groupBy(*by).agg(F.count("*").alias("points"), *(F.avg(c).alias(c) for c in "xyz")).where(F.col("points") >= least)


def diverse_points(points: DataFrame, most: int, by: str = "structure_id") -> DataFrame:
    """Round robin over types by distance: at most ceil(most / types) of a type, ``most`` together."""
    kinds = F.size(F.collect_set("type").over(W.partitionBy(by)))
    own = F.row_number().over(W.partitionBy(by, "type").orderBy("distance", "id"))
    capped = points.withColumns({"kinds": kinds, "rn": own}).where(F.col("rn") <= F.ceil(F.lit(most) / F.col("kinds")))
    place = F.row_number().over(W.partitionBy(by).orderBy("rn", "type", "id"))
    return capped.withColumn("place", place).where(F.col("place") <= most).drop("kinds")


def choose_altloc(atoms: DataFrame, key: tuple[str, ...], tie: float = 1e-6) -> DataFrame:
    """One position per atom: largest occupancy; ties by altloc, then position; ``tied`` counts them."""
    top = F.max("occ").over(W.partitionBy(*key))
    near = atoms.withColumn("top", top).where(F.col("occ") >= F.col("top") - tie)
    own = W.partitionBy(*key)
    return near.withColumns({"tied": F.count("*").over(own), "rn": F.row_number().over(own.orderBy("altloc", "x", "y", "z"))}).where("rn = 1").drop("rn", "top")


def cluster_points(points: DataFrame, threshold: float = 1.5, by: str = "structure_id") -> DataFrame:
    """Greedy clusters of same-type points by running centroid, in (type, position) order.

    The rule is sequential inside a structure, whose points are few; structures are rows, many to a batch.
    """
    import pandas as pd

    def clusters(points):
        centers: list[list] = []
        for kind, x, y, z in points:
            for c in centers:
                if c[0] == kind and ((c[1] - x) ** 2 + (c[2] - y) ** 2 + (c[3] - z) ** 2) ** 0.5 <= threshold:
                    n = c[4]
                    c[1:] = [(c[1] * n + x) / (n + 1), (c[2] * n + y) / (n + 1), (c[3] * n + z) / (n + 1), n + 1]
                    break
            else:
                centers.append([kind, x, y, z, 1])
        return centers

    def run(batches):
        for pdf in batches:
            out = [(s, *c) for s, p in zip(pdf[by], pdf["p"]) for c in clusters([(q["type"], q["x"], q["y"], q["z"]) for q in p])]
            yield pd.DataFrame(out, columns=[by, "type", "x", "y", "z", "members"])

    kind = dict(points.dtypes)[by]
    rows = points.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("type", "x", "y", "z"))).alias("p"))
    return rows.mapInPandas(run, f"{by} {kind}, type string, x double, y double, z double, members long")

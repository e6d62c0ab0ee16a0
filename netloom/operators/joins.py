"""Nearest, band and reference joins, all planned as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.functions import geo
from netloom.functions.keys import ref_key
from netloom.operators.spatial import cell, cell_key, finite
from netloom.session import cut


def _cells(x: Column, y: Column, size: float, around: int) -> Column:
    cx, cy = cell(x, size), cell(y, size)
    return F.array(*[cell_key(cx + i, cy + j) for i in range(-around, around + 1) for j in range(-around, around + 1)])


def candidate_edges(left: DataFrame, right: DataFrame, radius: float, blocks: list[str] | None = None, strict: bool = False, left_cols: tuple[str, ...] = (), right_cols: tuple[str, ...] = ()) -> DataFrame:
    """(blocks, left_id, right_id, d): pairs of (id, x, y) no further apart than radius (strict: nearer), within equal blocks.

    The right side is copied to the nine cells around its own; give the smaller table there. Rows without finite
    coordinates have no pairs. left_cols and right_cols come along from either side, so the pairs need no join for them.
    """
    on = list(blocks or [])
    size = max(radius * 1.0000001, 1e-9)
    lhs = left.where(finite(F.col("x"), F.col("y"))).select(*on, *left_cols, F.col("id").alias("left_id"), F.col("x").alias("__lx"), F.col("y").alias("__ly"), cell_key(cell(F.col("x"), size), cell(F.col("y"), size)).alias("__c"))
    rhs = right.where(finite(F.col("x"), F.col("y"))).select(*on, *right_cols, F.col("id").alias("right_id"), F.col("x").alias("__rx"), F.col("y").alias("__ry"), F.explode(_cells(F.col("x"), F.col("y"), size, 1)).alias("__c"))
    d = geo.distance(F.col("__lx"), F.col("__ly"), F.col("__rx"), F.col("__ry"))
    pairs = lhs.join(rhs, [*on, "__c"]).withColumn("d", d)
    return pairs.where((F.col("d") < radius) if strict else (F.col("d") <= radius)).select(*on, "left_id", "right_id", "d", *left_cols, *right_cols)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, blocks: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(blocks, left_id, right_id, d): the nearest right row within radius, the least id on ties; left rows without one are left out."""
    e = candidate_edges(left, right, radius, blocks, strict)
    best = e.groupBy(*(blocks or []), "left_id").agg(F.min(F.struct("d", "right_id")).alias("b"))
    return best.select(*(blocks or []), "left_id", F.col("b.right_id").alias("right_id"), F.col("b.d").alias("d"))


def nearest_any(left: DataFrame, right: DataFrame, start: float) -> DataFrame:
    """(left_id, right_id, d): the nearest right row however far, the least id on ties.

    The radius grows eightfold from `start` for the rows that are still without one, until it spans both tables.
    """
    spark = left.sparkSession
    ok = finite(F.col("x"), F.col("y"))
    ends = left.where(ok).select("x", "y").unionByName(right.where(ok).select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    far = ((ends[0] or 0.0) ** 2 + (ends[1] or 0.0) ** 2) ** 0.5 * 1.001 + start
    out, rest, radius = None, left.where(ok).select("id", "x", "y"), start
    if right.where(ok).isEmpty():
        return spark.createDataFrame([], f"left_id {left.schema['id'].dataType.simpleString()}, right_id {right.schema['id'].dataType.simpleString()}, d double")
    while True:
        got = cut(nearest_within(rest, right, radius))
        out = got if out is None else out.unionByName(got)
        if radius >= far:
            return out
        rest = cut(rest.join(got, rest["id"] == got["left_id"], "left_anti"))
        if rest.isEmpty():
            return out
        radius = min(radius * 8, far)


def merge_nearest(targets: DataFrame, annotations: DataFrame, radius: float) -> DataFrame:
    """targets (id, x, y, text, attrs) with the nearest annotations' text and attributes merged in.

    Each annotation goes to its nearest target nearer than radius. Attributes a target has stay; among annotations the
    earliest id wins; the text is taken once, from the earliest. attrs: map<string,string>.
    """
    near = nearest_within(annotations, targets, radius, strict=True)
    linked = near.join(annotations.select(F.col("id").alias("left_id"), F.col("text").alias("a_text"), F.col("attrs").alias("a_attrs")), "left_id")
    pairs = linked.select("right_id", "left_id", F.explode_outer("a_attrs").alias("k", "v")).where("k IS NOT NULL").groupBy("right_id", "k").agg(F.min_by("v", "left_id").alias("v"))
    attrs = pairs.groupBy("right_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new_attrs"))
    text = linked.where("a_text IS NOT NULL").groupBy("right_id").agg(F.min_by("a_text", "left_id").alias("new_text"))
    t = targets.join(attrs, targets["id"] == attrs["right_id"], "left").drop("right_id").join(text, targets["id"] == text["right_id"], "left").drop("right_id")
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce("attrs", none)
    fresh = F.map_filter(F.coalesce("new_attrs", none), lambda k, v: ~F.map_contains_key(old, k))
    return t.withColumns({"attrs": F.map_concat(old, fresh), "text": F.coalesce("text", "new_text")}).drop("new_attrs", "new_text")


def code_set(df: DataFrame, field: str) -> DataFrame:
    """Distinct codes, upper case and trimmed, without empty ones."""
    return df.select(ref_key(field).alias("code")).where("code IS NOT NULL").distinct()


def reference_isolation(parents: DataFrame, key: str, children: DataFrame, child_id: str, ref: str) -> DataFrame:
    """(side, item): `child` with the id of each child whose reference is null, blank or no parent's, `parent` with each parent code that no child names."""
    codes = code_set(parents, key)
    c = children.select(F.col(child_id).cast("string").alias("item"), ref_key(ref).alias("code"))
    lost = c.join(codes, "code", "left_anti").select(F.lit("child").alias("side"), "item")
    bare = codes.join(c.select("code").distinct(), "code", "left_anti").select(F.lit("parent").alias("side"), F.col("code").alias("item"))
    return lost.unionByName(bare)


def isolation(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(side, code): codes of the left without a counterpart on the right (`left`) and the other way round (`right`)."""
    a, b = code_set(left, left_key), code_set(right, right_key)
    return a.join(b, "code", "left_anti").select(F.lit("left").alias("side"), "code").unionByName(b.join(a, "code", "left_anti").select(F.lit("right").alias("side"), "code"))


def resolve_endpoints(edges: DataFrame, edge_id: str, ends: dict[str, str], tables: dict[str, DataFrame]) -> DataFrame:
    """(edge_id, end, ref, found_in): each end of each edge with the first table (by name order) that has its code; `null` without a reference, `nowhere` without a target.

    ends: end name -> column; tables: name -> DataFrame of `code`.
    """
    long = edges.select(F.col(edge_id).alias("edge_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("end"), ref_key(c).alias("ref")) for n, c in ends.items()])).alias("e")).select("edge_id", "e.end", "e.ref")
    every = None
    for name in sorted(tables):
        t = tables[name].select(F.col("code").alias("ref"), F.lit(name).alias("t")).distinct()
        every = t if every is None else every.unionByName(t)
    first = every.groupBy("ref").agg(F.min("t").alias("t"))
    return long.join(first, "ref", "left").select("edge_id", "end", "ref", F.when(F.col("ref").isNull(), "null").otherwise(F.coalesce("t", F.lit("nowhere"))).alias("found_in"))


def outside_named_region(points: DataFrame, point_id: str, ref: str, regions: DataFrame, code: str, ring: str) -> DataFrame:
    """(point_id, ref, why): points (x, y) that don't lie strictly inside a region their reference names; a missing region is a violation, several regions of one code are all looked at."""
    p = points.select(F.col(point_id).alias("point_id"), ref_key(ref).alias("ref"), "x", "y")
    r = regions.select(ref_key(code).alias("ref"), F.col(ring).alias("ring")).where("ref IS NOT NULL AND ring IS NOT NULL")
    j = p.join(r, "ref", "left").groupBy("point_id", "ref").agg(F.max(F.col("ring").isNotNull()).alias("known"), F.max(F.coalesce(geo.contains(F.col("x"), F.col("y"), F.col("ring")), F.lit(False))).alias("inside"))
    return j.where("NOT inside").select("point_id", "ref", F.when(F.col("known"), "outside").otherwise("no region").alias("why"))


def lines_outside_region(lines: DataFrame, line_id: str, ref: str, regions: DataFrame, code: str, ring: str) -> DataFrame:
    """(line_id, ref, first_outside): lines (points) with a vertex outside the region they name, and its position."""
    r = regions.select(ref_key(code).alias("ref"), F.col(ring).alias("ring")).where("ref IS NOT NULL AND ring IS NOT NULL")
    j = lines.select(F.col(line_id).alias("line_id"), ref_key(ref).alias("ref"), "points").join(r, "ref", "left")
    flags = F.transform("points", lambda p: F.coalesce(geo.contains(p["x"], p["y"], F.col("ring")), F.lit(False)))
    return j.withColumn("first_outside", F.array_position(flags, False)).where("first_outside > 0").select("line_id", "ref", "first_outside")


def overlapping_regions(regions: DataFrame, region_id: str, ring: str, cell_size: float) -> DataFrame:
    """(left_id, right_id), left_id < right_id, of regions whose interiors overlap; containment is no overlap.

    A region is registered in the grid cells of its box; a pair is tested in the first cell that both have.
    """
    b = geo.bbox(F.col("ring"))
    r = regions.select(F.col(region_id).alias("id"), F.col(ring).alias("ring")).where("size(ring) >= 3").withColumn("b", b)
    span = lambda lo, hi: F.sequence(cell(F.col(f"b.{lo}"), cell_size), cell(F.col(f"b.{hi}"), cell_size))
    g = r.select("*", F.explode(span("xmin", "xmax")).alias("gx")).select("*", F.explode(span("ymin", "ymax")).alias("gy"))
    a, c = g.select(*[F.col(k).alias(f"a_{k}") for k in ("id", "ring", "b")], "gx", "gy"), g.select(*[F.col(k).alias(f"c_{k}") for k in ("id", "ring", "b")], "gx", "gy")
    meet = (F.col("a_b.xmin") < F.col("c_b.xmax")) & (F.col("c_b.xmin") < F.col("a_b.xmax")) & (F.col("a_b.ymin") < F.col("c_b.ymax")) & (F.col("c_b.ymin") < F.col("a_b.ymax"))
    first = (F.col("gx") == cell(F.greatest("a_b.xmin", "c_b.xmin"), cell_size)) & (F.col("gy") == cell(F.greatest("a_b.ymin", "c_b.ymin"), cell_size))
    return a.join(c, ["gx", "gy"]).where((F.col("a_id") < F.col("c_id")) & meet & first & geo.overlaps(F.col("a_ring"), F.col("c_ring"))).select(F.col("a_id").alias("left_id"), F.col("c_id").alias("right_id"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell_size: float, blocks: list[str] | None = None) -> DataFrame:
    """(box_id, point_id): points (id, x, y) inside or on boxes (id, xmin, xmax, ymin, ymax) of equal blocks.

    Grids double in cell size; a box lies in the grid whose cells are no smaller than itself, so it covers four cells at
    most however large it is, and a point is looked up once for each grid in use (at most some 60).
    """
    on = [*(blocks or []), "lv", "gx", "gy"]
    ok = boxes.where("xmin <= xmax AND ymin <= ymax").where(finite(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")]))
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    b = ok.select(*(blocks or []), F.col("id").alias("box_id"), "xmin", "xmax", "ymin", "ymax", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(cell_size)) / cell_size))).cast("int").alias("lv"))
    b = cut(b)
    levels = sorted(r[0] for r in b.select("lv").distinct().collect())  # a row a doubling
    at = lambda c: cell(F.col(c) / F.pow(F.lit(2.0), F.col("lv")), cell_size)
    b = b.select("*", F.explode(F.sequence(at("xmin"), at("xmax"))).alias("gx")).select("*", F.explode(F.sequence(at("ymin"), at("ymax"))).alias("gy"))
    p = points.where(finite(F.col("x"), F.col("y"))).select(*(blocks or []), F.col("id").alias("point_id"), "x", "y", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("lv"))
    p = p.select("*", at("x").alias("gx"), at("y").alias("gy"))
    side = b.select(*[F.col(c).alias(f"__b_{c}") if c in on else F.col(c) for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in on]
    return p.join(side, same).where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").select("box_id", "point_id")


def label_scores(components: DataFrame, layouts: DataFrame) -> DataFrame:
    """(component, layout, exact, prefix, score): 2 for each label both have, 1 for each other component label that is the layout's name or begins with it and a dot; pairs without either are left out.

    components: component, label; layouts: layout (its name), label. Labels count once, without regard to case and white
    space around. Both ways are equi-joins, on the label and on what stands before one of its dots.
    """
    code = lambda c: F.upper(F.trim(F.col(c)))
    c = components.select("component", code("label").alias("label")).where("label <> ''").distinct()
    y = layouts.select("layout", code("label").alias("label")).distinct()
    both = c.join(y, "label").select("component", "layout", "label")
    exact = both.groupBy("component", "layout").agg(F.count(F.lit(1)).alias("exact"))
    names = y.select("layout", code("layout").alias("head")).where("head <> ''").distinct()
    parts = F.size(F.split("label", r"\."))
    heads = c.select("component", "label", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), parts), lambda i: F.array_join(F.slice(F.split(F.col("label"), r"\."), F.lit(1), i), ".")))).alias("head"))
    prefix = heads.join(names, "head").select("component", "layout", "label").join(both, ["component", "layout", "label"], "left_anti").groupBy("component", "layout").agg(F.count(F.lit(1)).alias("prefix"))
    return exact.join(prefix, ["component", "layout"], "full_outer").fillna(0, ["exact", "prefix"]).withColumn("score", 2 * F.col("exact") + F.col("prefix"))


def duplicate_lines(lines: DataFrame, tol: float = 0.001) -> DataFrame:
    """lines (id, layer, points, text) without those that repeat another of their layer: vertices within tol of each other.

    Of such lines the one with a text stays, then the least id. Lines equal in every vertex are told by their hash first. The
    others' extents in four directions move by no more than tol from a line to one that repeats it: a line meets those
    whose eight extents lie in the cells of its own or in cells within tol of them, so each pair is compared once.
    """
    if tol <= 0:
        return lines
    size = tol * 64
    known = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    sane = lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
    g = lines.select("id", "layer", known.alias("points"), (F.col("text").isNull() | (F.col("text") == "")).alias("bare")).where("layer IS NOT NULL AND size(points) > 0").where(F.forall("points", sane))
    same = Window.partitionBy("layer", "__h", "points")
    g = g.withColumn("__h", F.xxhash64("points")).withColumn("__best", F.min(F.struct("bare", "id")).over(same)).withColumn("__again", F.struct("bare", "id") != F.col("__best"))
    onto = lambda u, v: F.transform("points", lambda p: p["x"] * u + p["y"] * v)
    along = [onto(1.0, 0.0), onto(0.0, 1.0), onto(0.6, 0.8), onto(0.8, -0.6)]
    g = cut(g.select("id", "layer", "bare", "__again", F.when(~F.col("__again"), F.col("points")).alias("points"), F.when(~F.col("__again"), F.array(*[f(v) for v in along for f in (F.array_min, F.array_max)])).alias("__e")))
    one = g.where("NOT __again")
    slack = lambda v: tol * 1.0001 + F.abs(v) * 1e-12
    spread = lambda keys, near: F.flatten(F.transform(keys, lambda s: F.transform(near, lambda c: F.xxhash64(s, c))))
    own, keys = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    for k in range(8):
        v = F.col("__e")[k]
        own, keys = F.xxhash64(own, cell(v, size)), spread(keys, F.array_distinct(F.array(cell(v - slack(v), size), cell(v + slack(v), size))))
    side = lambda s, key: one.select("layer", key.alias("__k"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "points", "bare", "__e")])
    better = F.struct("a_bare", "a_id") < F.struct("c_bare", "c_id")
    close = F.forall(F.zip_with("a___e", "c___e", lambda u, v: F.abs(u - v) <= slack(u)), lambda ok: ok)
    pairs = side("a", own).join(side("c", F.explode(F.array_distinct(keys))), ["layer", "__k"]).where(better & close)
    gone = pairs.where(geo.hausdorff(F.col("a_points"), F.col("c_points")) < tol).select(F.col("c_id").alias("id"))
    return lines.join(gone.unionByName(g.where("__again").select("id")).distinct(), "id", "left_anti")


def scored_links(texts: DataFrame, geometries: DataFrame, sigma: float, accept: float = 0.6) -> DataFrame:
    """(text_id, geometry_id, score): each text's best geometry within five sigma by 0.7 exp(-d/sigma) + 0.3 semantic, if it reaches `accept`.

    texts: id, x, y, semantic; geometries: id, x, y. Ties go to the least geometry id.
    """
    e = candidate_edges(texts, geometries, 5 * sigma).join(texts.select(F.col("id").alias("left_id"), "semantic"), "left_id")
    s = e.withColumn("score", F.round(0.7 * F.exp(-F.col("d") / sigma) + 0.3 * F.col("semantic"), 12)).where(F.col("score") >= accept)
    r = s.withColumn("__r", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))).where("__r = 1")
    return r.select(F.col("left_id").alias("text_id"), F.col("right_id").alias("geometry_id"), "score")

"""The stages of a conversion as one run: routing, classification, legends, fusion, ledger, quality figures and verdict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import geo
from netloom.functions import text as T
from netloom.functions.keys import is_empty, ref_key
from netloom.operators import aggregates as A
from netloom.operators import rules as R
from netloom.operators.graph import proximity_clusters
from netloom.operators.joins import candidate_edges, nearest_within
from netloom.operators.legend import exclude_legends, legend_clusters
from netloom.operators.spatial import cell, cell_key, finite
from netloom.operators.topology import assign_labels
from netloom.session import cut

# --- stage by stage ---------------------------------------------------------------------------------------------------


def route(entities: DataFrame) -> DataFrame:
    """entities (layer, text, x, y) with `port`, where a discarded one goes (NULL if kept), and `fc_name`, `confidence`, `method` of the kept.

    Without finite coordinates: invalid_coordinate; on a layer of negative evidence: negative_evidence; without a text: empty_text.
    """
    port = F.when(~finite(F.col("x"), F.col("y")), "invalid_coordinate").when(T.negative(F.coalesce("layer", F.lit(""))), "negative_evidence").when(is_empty("text"), "empty_text")
    tiers = entities.withColumns({"port": port, "__one": T.tier1(F.col("layer")), "__two": T.tier2(F.col("text"))})
    c = tiers.withColumn("__c", T.assign_class(F.col("__one"), F.col("__two")))
    kept = lambda k: F.when(F.col("port").isNull(), F.col(f"__c.{k}")).alias(k)
    return c.withColumns({k: kept(k) for k in ("fc_name", "confidence", "method")}).drop("__one", "__two", "__c")


def regime_fits(x: Column, y: Column, regime: Column, offsets: dict[str, tuple[float, float]], box: tuple[float, float, float, float]) -> Column:
    """Whether a point moved by its regime's offset (any name but the first: the second's) lies in the box (xmin, xmax, ymin, ymax), borders included."""
    (first, a), (_, b) = list(offsets.items())[:2]
    ux, uy = (v + F.when(regime == first, a[k]).otherwise(b[k]) for k, v in enumerate((x, y)))
    return ux.between(box[0], box[1]) & uy.between(box[2], box[3])


def map_schema(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """features (layer, geom, text) with `fc_name`, `schema_confidence` and `mismatch` by a mapping (layer, fc, expected) of layers.

    A layer of the mapping gives its class with confidence 1; another geometry than expected gives 0.3 and the class's
    `_labels` for a point with a text, else fc_misc, a mismatch. Layers without a mapping give fc_misc with 0.5. A geometry
    named Geometry fits any. mapping has one row a layer.
    """
    m = mapping.select(F.col("layer").alias("__l"), "fc", "expected")
    odd = (F.col("geom") != "Geometry") & (F.col("geom") != F.col("expected"))
    label = (F.col("geom") == "Point") & F.col("text").isNotNull() & (F.col("text") != "")
    j = features.join(m, F.col("layer") == F.col("__l"), "left")
    fc = F.when(F.col("fc").isNull(), "fc_misc").when(odd & label, F.concat("fc", F.lit("_labels"))).when(odd, "fc_misc").otherwise(F.col("fc"))
    return j.withColumns({"fc_name": fc, "schema_confidence": F.when(F.col("fc").isNull(), 0.5).when(odd, 0.3).otherwise(1.0), "mismatch": F.coalesce(odd & ~label, F.lit(False)) & F.col("fc").isNotNull()}).drop("__l", "fc", "expected")


def quality(entities: DataFrame, out: DataFrame, topology: DataFrame, residuals: DataFrame, texts: DataFrame) -> DataFrame:
    """(metric, value, target_met): completeness, topology violations, precision, linkage, conformance and automation.

    entities: human_review; out: fc_name; topology: entities_in, repairs (a row a report); residuals: max_residual;
    texts: linked. Without control points Q3 is NULL and not met; without any entities the shares are 0 (conformance and automation 1).
    """
    n_in = entities.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("human_review").cast("long")), F.lit(0)).alias("reviewed"))
    n_out = out.agg(F.count(F.lit(1)).alias("n_out"), F.coalesce(F.sum((F.col("fc_name") == "fc_misc").cast("long")), F.lit(0)).alias("misc"))
    t = topology.agg(F.coalesce(F.sum("repairs"), F.lit(0)).alias("repairs"), F.coalesce(F.sum("entities_in"), F.lit(0)).alias("topo"))
    g = residuals.agg(F.max("max_residual").alias("residual"))
    x = texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.col("linked").cast("long")), F.lit(0)).alias("linked"))
    one = reduce(lambda a, b: a.join(b, "__k"), [df.withColumn("__k", F.lit(1)) for df in (n_in, n_out, t, g, x)])  # five rows of one
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(float(none))
    rows = [("Q1", share("n_out", "n", 0), lambda v: v >= 0.95), ("Q2", share("repairs", "topo", 0), lambda v: v <= 0.02), ("Q3", F.col("residual"), lambda v: F.coalesce(v <= 0.0012, F.lit(False))), ("Q4", share("linked", "texts", 0), lambda v: v >= 0.70), ("Q5", 1 - share("misc", "n_out", 0), lambda v: v >= 0.80), ("automation", 1 - share("reviewed", "n", 0), lambda v: v >= 0.90)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), met(v).alias("target_met")) for k, v, met in rows]))
    return one.select(each.alias("m")).select("m.metric", F.when(F.col("m.metric") == "Q3", F.col("m.value")).otherwise(F.round("m.value", 4)).alias("value"), "m.target_met")


# --- lines and their nodes -----------------------------------------------------------------------------------------------


def endpoint_coincidence(lines: DataFrame, nodes: DataFrame, tol: float) -> DataFrame:
    """(line_id, problem, end): `null_end` for a missing code at either end, `self_loop` for one code at both, `off_node` for an end further than tol from the node it names.

    lines: id, from_code, to_code, points; nodes: code, x, y (of several nodes of a code the least position counts). Ends
    that name an unknown node are no violation here. Lines of fewer than two points have no ends.
    """
    a, b = ref_key("from_code"), ref_key("to_code")
    base = cut(lines.select(F.col("id").alias("line_id"), a.alias("a"), b.alias("b"), F.when(F.size("points") >= 2, F.element_at("points", 1)).alias("p"), F.when(F.size("points") >= 2, F.element_at("points", -1)).alias("q")))
    bare = base.where("a IS NULL OR b IS NULL").select("line_id", F.lit("null_end").alias("problem"), F.when(F.col("a").isNull() & F.col("b").isNull(), "both").when(F.col("a").isNull(), "from").otherwise("to").alias("end"))
    loop = base.where("a = b").select("line_id", F.lit("self_loop").alias("problem"), F.lit("both").alias("end"))
    ends = base.select("line_id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("a").alias("code"), F.col("p").alias("p")), F.struct(F.lit("to").alias("end"), F.col("b").alias("code"), F.col("q").alias("p")))).alias("e")).select("line_id", "e.end", "e.code", "e.p").where("code IS NOT NULL AND p IS NOT NULL")
    at = nodes.where(finite(F.col("x"), F.col("y"))).groupBy(ref_key("code").alias("code")).agg(F.min(F.struct("x", "y")).alias("n")).where("code IS NOT NULL")
    off = ends.join(at, "code").where(geo.distance(F.col("p.x"), F.col("p.y"), F.col("n.x"), F.col("n.y")) > tol).select("line_id", F.lit("off_node").alias("problem"), "end")
    return bare.unionByName(loop).unionByName(off)


def nearest_line(spans: DataFrame, lines: DataFrame, tol: float) -> DataFrame:
    """(span_id, line_id, d): the nearest line within tol of each span, line to line, the least id on ties; spans without one are left out.

    spans and lines: id, points. Both walk the cells of a grid of eight times tol; lines are copied to the cells around
    theirs. A cell's lines lie in order of their ids, so a span is done with the first that it meets; no pairs are listed.
    """
    size = max(8 * tol, 1e-9)
    step = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"
    single = lambda p: F.when(F.size(p) == 1, F.array(F.struct(F.element_at(p, 1).alias("a"), F.element_at(p, 1).alias("b")))).otherwise(geo._pairs(p)).cast(step)

    parts = ["id", "x", "y", "x1", "y1"]

    def celled(df: DataFrame, name: str, reach: float) -> DataFrame:
        """(id, x, y, x1, y1, c), all with the name before them: each step of at most a cell along a segment, in the cells that its box, widened by reach, touches."""
        seg = df.select("id", F.explode(single(F.col("points"))).alias("s")).where(finite(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")))
        n = F.greatest(F.lit(1), F.ceil(geo.distance(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")) / size)).cast("int")
        ends = lambda k, i: (F.col(f"s.a.{k}") + (F.col(f"s.b.{k}") - F.col(f"s.a.{k}")) * i / n, F.col(f"s.a.{k}") + (F.col(f"s.b.{k}") - F.col(f"s.a.{k}")) * (i + 1) / n)

        def cells(k: str, i: Column) -> Column:
            u, v = ends(k, i)
            more = reach * 1.000001 + F.abs(u) * 1e-12
            return F.sequence(cell(F.least(u, v) - more, size), cell(F.greatest(u, v) + more, size))

        every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(F.transform(cells("x", i), lambda gx: F.transform(cells("y", i), lambda gy: cell_key(gx, gy))))))
        return seg.select("id", "s.a.x", "s.a.y", "s.b.x", "s.b.y", F.explode(F.array_distinct(every))).toDF(*[f"{name}_{c}" for c in (*parts, "c")])

    # where a line comes within tol of a span, the line's cells, widened by tol, have the cell of the span's nearest point
    a, b = celled(spans, "span", 0.0), celled(lines, "line", tol)
    kinds = [df.schema["id"].dataType.simpleString() for df in (spans, lines)]

    def best(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        mine, others = mine.iloc[:, :6].set_axis([*parts, "c"], axis=1), others.iloc[:, :6].set_axis([*parts, "c"], axis=1).sort_values(["c", "id"])
        mine = mine.sort_values("c")
        cells, first = np.unique(mine.c.to_numpy(), return_index=True)
        lo, hi = (np.searchsorted(others.c.to_numpy(), cells, side) for side in ("left", "right"))
        got = [r for i, j, k, m in zip(first, np.append(first[1:], len(mine)), lo, hi) if k < m for r in _nearest_in_cell(mine.iloc[i:j], others.iloc[k:m], tol)]
        return pd.DataFrame(got, columns=["span_id", "line_id", "d"])

    calls = 8 * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # many cells share a task's call
    a, b = (df.withColumn(f"{k}_call", F.pmod(F.xxhash64(f"{k}_c"), F.lit(calls))) for df, k in ((a, "span"), (b, "line")))
    found = a.groupBy("span_call").cogroup(b.groupBy("line_call")).applyInPandas(best, f"span_id {kinds[0]}, line_id {kinds[1]}, d double")
    return found.groupBy("span_id").agg(F.min(F.struct("d", "line_id")).alias("b")).select("span_id", F.col("b.line_id").alias("line_id"), F.col("b.d").alias("d"))


def _nearest_in_cell(spans: pd.DataFrame, lines: pd.DataFrame, tol: float) -> list[tuple]:
    """(span, line, d) of each segment of spans with a segment of lines (id, x, y, x1, y1; in order of id) within tol, the least id on ties."""
    ids = lines.id.tolist()
    bx, by, qx, qy = (lines[k].to_numpy() for k in ("x", "y", "x1", "y1"))
    lo_x, hi_x, lo_y, hi_y = np.minimum(bx, qx), np.maximum(bx, qx), np.minimum(by, qy), np.maximum(by, qy)
    out = []
    for span, ax, ay, px, py in zip(spans.id.tolist(), *(spans[k].tolist() for k in ("x", "y", "x1", "y1"))):
        least, at, start, chunk = np.inf, -1, 0, 128
        while start < len(ids) and least > 0:
            # the line must come nearer than what is known so far
            r = min(tol, least) * (1 + 1e-9) + 1e-12 * max(abs(ax), abs(ay))
            s = slice(start, start + chunk)
            k = start + np.flatnonzero((lo_x[s] <= max(ax, px) + r) & (hi_x[s] >= min(ax, px) - r) & (lo_y[s] <= max(ay, py) + r) & (hi_y[s] >= min(ay, py) - r))
            if len(k):
                d = _segments_apart(ax, ay, px, py, bx[k], by[k], qx[k], qy[k])
                j = int(d.argmin())
                if d[j] <= tol and d[j] < least:
                    least, at = float(d[j]), int(k[j])
            start, chunk = start + chunk, min(chunk * 4, 1 << 16)
        if at >= 0:
            out.append((span, ids[at], least))
    return out


def _segments_apart(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Distance of the segment a-b from each segment c-d: 0 where they cross, else the least of an end from the other segment."""
    turn = lambda px, py, qx, qy, x, y: (px - x) * (qy - y) - (qx - x) * (py - y)

    def to(px, py, sx, sy, tx, ty):
        ex, ey = tx - sx, ty - sy
        norm = ex * ex + ey * ey
        t = np.where(norm == 0, 0.0, np.clip(((px - sx) * ex + (py - sy) * ey) / np.where(norm == 0, 1.0, norm), 0.0, 1.0))
        u, v = px - (sx + t * ex), py - (sy + t * ey)
        return np.sqrt(u * u + v * v)

    meet = (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)
    apart = np.minimum(np.minimum(to(ax, ay, cx, cy, dx, dy), to(bx, by, cx, cy, dx, dy)), np.minimum(to(cx, cy, ax, ay, bx, by), to(dx, dy, ax, ay, bx, by)))
    return np.where(meet, 0.0, apart)


# --- labels and representations ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """A family of labels: its targets' class, its reach and the colour its targets must have (`#FF0000`) or not have (`!#FF0000`)."""

    name: str
    target_fc: str
    tol: float
    colour: str | None = None


def link_labels(labels: DataFrame, targets: DataFrame, families: list[Family], sigma: float) -> DataFrame:
    """(label_id, family, target_id, d, status) of every label in three stages.

    A label whose whole text fits a family's pattern is assigned one to one among the family's targets within its reach
    (see assign_labels); any other goes to the nearest target nearer than sigma (`linked`) or nowhere (`unlinked`).
    labels: id, x, y, text; targets: id, x, y, fc_name, rgb.
    """
    gated = cut(labels.withColumn("family", T.family(F.trim("text"))))
    out = []
    for f in families:
        fit = targets.where(F.col("fc_name") == f.target_fc)
        if f.colour:
            same = F.coalesce(F.col("rgb") == f.colour.lstrip("!"), F.lit(False))
            fit = fit.where(~same if f.colour.startswith("!") else same)
        out.append(assign_labels(gated.where(F.col("family") == f.name), fit, f.tol).select("label_id", F.lit(f.name).alias("family"), "target_id", "d", "status"))
    rest = gated.where(F.col("family").isNull() | ~F.col("family").isin([f.name for f in families]))
    near = nearest_within(rest, targets, sigma, strict=True)
    j = rest.select(F.col("id").alias("label_id")).join(near.withColumnRenamed("left_id", "label_id"), "label_id", "left")
    out.append(j.select("label_id", F.lit(None).cast("string").alias("family"), F.col("right_id").alias("target_id"), "d", F.when(F.col("right_id").isNull(), "unlinked").otherwise("linked").alias("status")))
    return reduce(DataFrame.unionByName, out)


def fold_representations(features: DataFrame, tol: float) -> DataFrame:
    """features (id, x, y, kind, layer, label) with `representation` and `disposition`: kept, merged, duplicate or secondary.

    Within tol features merge into one, a labelled one first, then a block, then the least id. Where any is labelled, an
    unlabelled (layer, kind) group as numerous as the labelled ones and beyond tol of all of them repeats them: its kind is
    added to theirs and it goes as duplicate; other unlabelled ones go to review as secondary.
    """
    c = cut(features.join(proximity_clusters(features.select("id", "x", "y"), tol), "id"))
    order = F.struct((F.coalesce(F.col("label"), F.lit("")) == "").alias("bare"), (F.col("kind") != "block").alias("other"), F.col("id").alias("id"))
    heads = c.groupBy("cluster").agg(F.min(order).alias("h"), F.collect_set("kind").alias("kinds"))
    m = cut(c.join(heads, "cluster").withColumns({"head": F.col("id") == F.col("h.id"), "bare": F.coalesce(F.col("label"), F.lit("")) == ""}).drop("h"))
    labelled = m.where("head AND NOT bare")
    n = labelled.count()
    groups = m.where("head AND bare").groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
    members = m.where("head AND bare").join(groups.drop("n"), ["layer", "kind"], "left_semi")
    close = candidate_edges(members.select("id", "x", "y"), labelled.select("id", "x", "y"), tol).select(F.col("left_id").alias("id")).distinct().join(members, "id").select("layer", "kind").distinct()
    folded = cut(groups.select("layer", "kind").join(close, ["layer", "kind"], "left_anti").withColumn("folded", F.lit(True)))
    more = [r["kind"] for r in folded.select("kind").distinct().collect()] if n else []  # a closed set of kinds
    j = m.join(folded, ["layer", "kind"], "left")
    lone = F.lit(n > 0) & F.col("bare")
    disposition = F.when(~F.col("head"), "merged").when(lone & F.coalesce("folded", F.lit(False)), "duplicate").when(lone, "secondary").otherwise("kept")
    kinds = F.when(F.col("bare"), F.col("kinds")).otherwise(F.array_union("kinds", F.array(*[F.lit(k) for k in more]).cast("array<string>")))
    return j.withColumns({"disposition": disposition, "representation": F.array_join(F.array_sort(kinds), "+")}).drop("cluster", "kinds", "head", "bare", "folded")


# --- the run ---------------------------------------------------------------------------------------------------------------


@dataclass
class Conversion:
    """What a run gives: features by class, discarded and reviewed entities, the ledger, counts by class and the rules with their verdict."""

    features: DataFrame
    quarantine: DataFrame
    ledger: DataFrame
    summary: DataFrame
    rules: DataFrame
    verdict: DataFrame


def gate(rule: DataFrame, strict: bool) -> DataFrame:
    """A provenance rule: a failure is a WARN of severity I, with strict a FAIL of severity E."""
    return rule.withColumns({"severity": F.lit("E" if strict else "I"), "status": F.when(F.col("status") == "PASS", "PASS").otherwise("FAIL" if strict else "WARN")})


def convert(entities: DataFrame, classes: list[str], drawing: str | None = None, confirmed: float | None = None, strict: bool = False) -> Conversion:
    """Entities (id, layer, text, x, y and the column `drawing`) routed, classified, freed of legends, counted and judged in one run.

    With `confirmed` the legends of each drawing are looked for: members of clusters that reach this confidence leave the
    features (port legend), those of others stay and are listed for review. Every entity is in the ledger once; rules: 3.0
    every class has a feature, 8.1 the ledger sums to the entities read, 9.1 no feature is left unclassified.
    """
    routed = cut(route(entities))
    kept = routed.where("port IS NULL").drop("port")
    drops = routed.where("port IS NOT NULL").select("port", "layer")
    review = kept.select("id", F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("reason")).limit(0)
    if confirmed is not None:
        by = [drawing] if drawing else []
        clusters, members = legend_clusters(kept.select(*by, "id", "x", "y", "text"), by)
        name = F.concat_ws("/", *by, "cluster")
        found = members.select(name.alias("cluster"), "id")
        free, review = exclude_legends(kept, found, clusters.select(name.alias("cluster"), (F.col("confidence") >= confirmed).alias("confirmed")))
        drops = drops.unionByName(kept.join(free.select("id"), "id", "left_anti").select(F.lit("legend").alias("port"), "layer"))
        kept = free
    kept = cut(kept)
    ledger = cut(A.conservation(kept.select(F.when(F.col("method") == "unclassified", "unclassified").otherwise("mapped").alias("disposition"), "layer", F.lit(1).alias("weight")), A.top_counts(drops, ["port", "layer"]), []))
    f = kept.select("fc_name", F.lit(False).alias("geographic_outlier"), F.col("confidence").alias("classification_confidence"))
    summary = cut(A.qc_summary(f, classes))
    read = entities.agg(F.count(F.lit(1)).alias("n"))
    total = ledger.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    off = total.join(read, F.col("total") != F.col("n"))  # a row each
    rules = R.report([R.rule("3.0", "C", summary.where("n = 0"), summary), gate(R.rule("8.1", "I", off, entities), strict), R.rule("9.1", "W", kept.where("method = 'unclassified'"), kept)])
    rules = cut(rules)
    return Conversion(kept, review, ledger, summary, rules, A.verdict(rules.where("severity <> 'I'")))

"""Queries of the conversion as one run and its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import joins as J
from netloom.operators import pipeline as L
from netloom.plans import relational as A
from netloom.plans import scalars as S
from netloom.plans import spatial_graph as G
from netloom.plans import views as V
from netloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intermediate_pipeline_dump").select(F.col("entity_id").alias("id"), "source_dwg", "layer", "type", "text", F.col("cx").alias("x"), F.col("cy").alias("y"))


_ROUTED = f"c AS ({S.SQL['classify']}), e AS (SELECT d.entity_id, layer, CASE WHEN cx IS NULL OR cy IS NULL THEN 'invalid_coordinate' WHEN c.method = 'negative_evidence' THEN 'negative_evidence' WHEN text IS NULL OR trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)) = '' THEN 'empty_text' END port, c.fc_name, c.method FROM intermediate_pipeline_dump d JOIN c ON c.entity_id = d.entity_id)"


@query(f"WITH {_ROUTED} SELECT coalesce(port, CASE WHEN method = 'unclassified' THEN 'unclassified' ELSE 'mapped' END) disposition, layer, count(*) n FROM e GROUP BY ALL")
def pipeline_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Where every entity of the dump went."""
    return L.convert(_entities(spark, d), A.CLASSES).ledger


@query(f"WITH {_ROUTED}, k AS (SELECT * FROM e WHERE port IS NULL), n AS (SELECT unnest({A.CLASSES}) fc), s AS (SELECT fc, count(k.entity_id) n FROM n LEFT JOIN k ON k.fc_name = fc GROUP BY 1), r AS (SELECT '3.0' rule_id, 'C' severity, count(*) FILTER (WHERE n = 0) v, count(*) n_evidence FROM s UNION ALL SELECT '8.1', 'I', (SELECT count(*) FROM intermediate_pipeline_dump) - (SELECT count(*) FROM e), (SELECT count(*) FROM intermediate_pipeline_dump) UNION ALL SELECT '9.1', 'W', count(*) FILTER (WHERE method = 'unclassified'), count(*) FROM k) SELECT rule_id, severity, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END status, v n_violations, n_evidence FROM r")
def pipeline_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the whole run."""
    return L.convert(_entities(spark, d), A.CLASSES).rules


@query(f"WITH r AS ({SQL['pipeline_rules']}), n AS (SELECT count(*) FILTER (WHERE status <> 'PASS' AND severity IN ('C', 'E')) errors, count(*) FILTER (WHERE status <> 'PASS' AND severity = 'W') warnings, count(*) FILTER (WHERE status = 'PASS') rules_passed, count(*) FILTER (WHERE status <> 'PASS') rules_failed FROM r WHERE severity <> 'I') SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'QUARANTINE' ELSE 'PASS' END verdict FROM n")
def pipeline_verdict(spark: SparkSession, d: str) -> DataFrame:
    return L.convert(_entities(spark, d), A.CLASSES).verdict


@query()
def pipeline_with_legends(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of a run that looks for the drawings' legends."""
    return L.convert(_entities(spark, d), A.CLASSES, "source_dwg", 0.7).ledger


_LAYERS = [("FAT CODE", "BOITE", "Point"), ("Home Nr", "IMB", "Polygon"), ("FO 24", "CABLE", "LineString"), ("POLE NEW 7", "PTECH", "Point")]


@query("WITH m AS (SELECT * FROM (VALUES ('FAT CODE', 'BOITE', 'Point'), ('Home Nr', 'IMB', 'Polygon'), ('FO 24', 'CABLE', 'LineString'), ('POLE NEW 7', 'PTECH', 'Point')) v(layer, fc, expected)), e AS (SELECT entity_id id, layer, text, CASE WHEN type = 'MTEXT' THEN 'LineString' WHEN type = 'TEXT' THEN 'Point' ELSE 'Geometry' END geom FROM intermediate_pipeline_dump), j AS (SELECT e.*, m.fc, m.expected, e.geom <> 'Geometry' AND e.geom <> m.expected odd, e.geom = 'Point' AND coalesce(text, '') <> '' lab FROM e LEFT JOIN m ON m.layer = e.layer) SELECT id, CASE WHEN fc IS NULL THEN 'fc_misc' WHEN odd AND lab THEN fc || '_labels' WHEN odd THEN 'fc_misc' ELSE fc END fc_name, CASE WHEN fc IS NULL THEN 0.5::DOUBLE WHEN odd THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END schema_confidence, coalesce(odd AND NOT lab, false) mismatch FROM j")
def schema_map(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("geom", F.when(F.col("type") == "MTEXT", "LineString").when(F.col("type") == "TEXT", "Point").otherwise("Geometry"))
    return L.map_schema(e, spark.createDataFrame(_LAYERS, "layer string, fc string, expected string")).select("id", "fc_name", "schema_confidence", "mismatch")


@query(f"WITH i AS (SELECT count(*) n, count(*) FILTER (WHERE type IS NULL OR trim(type) = '') rev FROM boite), c AS ({S.SQL['classify']}), o AS (SELECT count(*) n_out, count(*) FILTER (WHERE fc_name = 'fc_misc') misc FROM c), t AS (SELECT sum(c) topo, sum(c - k) repairs FROM (SELECT ref_plaque, count(*) c, count(DISTINCT code) k FROM boite GROUP BY 1)), g AS (SELECT max(s_suppkey % 7 * 0.00019) r FROM supplier), x AS (SELECT count(*) texts, count(text) linked FROM intermediate_pipeline_dump) SELECT 'Q1' metric, round(n_out / n, 4) AS value, n_out / n >= 0.95 target_met FROM i, o UNION ALL SELECT 'Q2', round(repairs / topo, 4), repairs / topo <= 0.02 FROM t UNION ALL SELECT 'Q3', r, r <= 0.0012 FROM g UNION ALL SELECT 'Q4', round(linked / texts, 4), linked / texts >= 0.7 FROM x UNION ALL SELECT 'Q5', round(1 - misc / n_out, 4), 1 - misc / n_out >= 0.8 FROM o UNION ALL SELECT 'automation', round(1 - rev / n, 4), 1 - rev / n >= 0.9 FROM i")
def quality_figures(spark: SparkSession, d: str) -> DataFrame:
    """Quality figures with boxes as what came in, classified entities as what came out, repeated codes as repairs."""
    b = table(spark, d, "boite")
    topo = b.groupBy("ref_plaque").agg(F.count(F.lit(1)).alias("entities_in"), F.countDistinct("code").alias("k")).withColumn("repairs", F.col("entities_in") - F.col("k"))
    texts = table(spark, d, "intermediate_pipeline_dump").select(F.col("text").isNotNull().alias("linked"))
    review = b.select((F.col("type").isNull() | (F.trim("type") == "")).alias("human_review"))
    return L.quality(review, S.classify(spark, d), topo, table(spark, d, "supplier").select((F.col("s_suppkey") % 7 * 0.00019).alias("max_residual")), texts)


@query(G._V + ", s AS (SELECT entity_id, cx, cy, CASE WHEN cy > 0 THEN 'A' ELSE 'B' END r FROM intermediate_pipeline_dump) SELECT entity_id, CASE WHEN r = 'A' THEN cx - 11000000 BETWEEN 400000 AND 450000 AND cy + 100 BETWEEN 0 AND 20000 ELSE cx - 11400000 BETWEEN 0 AND 50000 AND cy + 40000 BETWEEN 0 AND 20000 END fits FROM s")
def regime_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    """Whether the regime's offset brings an entity into its box: one box for each regime."""
    e = table(spark, d, "intermediate_pipeline_dump").withColumn("r", F.when(F.col("cy") > 0, "A").otherwise("B"))
    offsets = {"A": (-11_000_000.0, 100.0), "B": (-11_400_000.0, 40_000.0)}
    fit = lambda *box: L.regime_fits(F.col("cx"), F.col("cy"), F.col("r"), offsets, box)
    return e.select("entity_id", F.when(F.col("r") == "A", fit(400_000.0, 450_000.0, 0.0, 20_000.0)).otherwise(fit(0.0, 50_000.0, 0.0, 20_000.0)).alias("fits"))


@query(G._V + G._CABLE + ", l AS (SELECT id, CASE WHEN l % 7 = 0 THEN NULL ELSE from_code END f, CASE WHEN l % 5 = 0 THEN from_code ELSE to_code END t, ax, ay, bx, b_y FROM cable), n AS (SELECT code, round(x, -1) x, round(y, -1) y FROM node UNION ALL SELECT CAST(id AS VARCHAR), round(x, -1), round(y, -1) FROM csite) SELECT id line_id, 'null_end' problem, 'from' AS \"end\" FROM l WHERE f IS NULL UNION ALL SELECT id, 'self_loop', 'both' FROM l WHERE f = t UNION ALL SELECT l.id, 'off_node', 'from' FROM l JOIN n ON n.code = f WHERE sqrt(pow(ax - x, 2) + pow(ay - y, 2)) > 3 UNION ALL SELECT l.id, 'off_node', 'to' FROM l JOIN n ON n.code = t WHERE sqrt(pow(bx - x, 2) + pow(b_y - y, 2)) > 3")
def endpoint_coincidence(spark: SparkSession, d: str) -> DataFrame:
    """Cables against boxes placed to ten metres; some name no origin, some the same box twice."""
    c = V.cable(spark, d).withColumns({"k": F.floor(F.col("id") / 100_000_000)})
    c = c.withColumns({"to_code": F.when(F.col("k") % 5 == 0, F.col("from_code")).otherwise(F.col("to_code")), "from_code": F.when(F.col("k") % 7 == 0, None).otherwise(F.col("from_code"))})
    spot = lambda df, code: df.select(code.alias("code"), F.round("x", -1).alias("x"), F.round("y", -1).alias("y"))
    return L.endpoint_coincidence(c, spot(V.node(spark, d), F.col("code")).unionByName(spot(V.site(spark, d), F.col("id").cast("string"))), 3.0)


_PS = "sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"
_TT = "CASE WHEN {ax} = {bx} AND {ay} = {by} THEN 0 ELSE greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)))) END"


def _ps(p: tuple[str, str], s: tuple[str, str, str, str]) -> str:
    names = dict(zip(("px", "py", "ax", "ay", "bx", "by"), (*p, *s)))
    return _PS.format(t=f"({_TT.format(**names)})", **names)


_A, _B = ("a.ax", "a.ay", "a.bx", "a.b_y"), ("b.ax", "b.ay", "b.bx", "b.b_y")
_TURN = lambda s, p: f"(({s[2]} - {s[0]}) * ({p[1]} - {s[1]}) - ({s[3]} - {s[1]}) * ({p[0]} - {s[0]}))"
_MEET = f"{_TURN(_A, _B[:2])} * {_TURN(_A, _B[2:])} < 0 AND {_TURN(_B, _A[:2])} * {_TURN(_B, _A[2:])} < 0"


@query(G._V + G._CABLE + f", k AS (SELECT c.*, n.type FROM cable c JOIN node n ON n.id = c.r), m AS (SELECT a.id span_id, b.id line_id, CASE WHEN {_MEET} THEN 0 ELSE least({_ps(_A[:2], _B)}, {_ps(_A[2:], _B)}, {_ps(_B[:2], _A)}, {_ps(_B[2:], _A)}) END d FROM k a JOIN k b ON a.type = 'PTO' AND b.type <> 'PTO' AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) + 6 AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) + 6 WHERE least(a.ay, a.b_y) <= greatest(b.ay, b.b_y) + 6 AND least(b.ay, b.b_y) <= greatest(a.ay, a.b_y) + 6), q AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY d, line_id) r FROM m WHERE d <= 5) SELECT span_id, line_id, round(d, 6) d FROM q WHERE r = 1")
def span_to_cable(spark: SparkSession, d: str) -> DataFrame:
    """The cables to outlets as spans, each with its nearest other cable."""
    c = V.cable(spark, d).join(V.node(spark, d).select(F.col("code").alias("to_code"), "type"), "to_code")
    return L.nearest_line(c.where("type = 'PTO'"), c.where("type <> 'PTO'"), 5.0).withColumn("d", F.round("d", 6))


@query(f"WITH a AS (SELECT DISTINCT {A._K('code')} c FROM site WHERE type = 'PM' AND deleted_at IS NULL), b AS (SELECT fid, {A._K('ref_pm')} c FROM boite WHERE {A._K('cable_amont')} IS NOT NULL) SELECT 'child' side, CAST(fid AS VARCHAR) item FROM b WHERE c IS NULL OR c NOT IN (SELECT c FROM a WHERE c IS NOT NULL) UNION ALL SELECT 'parent', c FROM a WHERE c IS NOT NULL AND c NOT IN (SELECT c FROM b WHERE c IS NOT NULL)")
def site_cable_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on a cable whose site isn't in service and sites in service that no cable reaches."""
    on_cable = table(spark, d, "boite").where("nullif(upper(btrim(cable_amont, ' \t')), '') IS NOT NULL")
    return J.reference_isolation(table(spark, d, "site").where("type = 'PM' AND deleted_at IS NULL"), "code", on_cable, "fid", "ref_pm")


@query()
def label_links(spark: SparkSession, d: str) -> DataFrame:
    """Branching boxes as labels of two families and others, linked to the larger boxes."""
    k, i = F.col("id") % 3, F.col("id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("DMPH-"), i, F.lit(".1.A01"))).when(k == 1, F.concat(F.lit("MR.DMPH.P"), i)).otherwise("any")
    t = V.node(spark, d).select("id", "x", "y", F.when(F.col("type") == "BPE", "BOITE").otherwise("PTECH").alias("fc_name"), F.when(F.col("type") == "BPI", "#FF0000").alias("rgb"))
    return L.link_labels(V.site(spark, d).withColumn("text", text), t, [L.Family("fat", "BOITE", 15.0), L.Family("pole", "PTECH", 25.0, "!#FF0000")], 20.0)


@query()
def folded_representations(spark: SparkSession, d: str) -> DataFrame:
    """Larger boxes as representations: BPE blocks labelled, others circles and texts without a label."""
    n = V.node(spark, d).select("id", "x", "y", F.when(F.col("type") == "BPE", "block").when(F.col("type") == "BPI", "circle").otherwise("text").alias("kind"), F.col("type").alias("layer"), F.when(F.col("type") == "BPE", F.col("code")).alias("label"))
    return L.fold_representations(n, 5.0).select("id", "representation", "disposition")

"""Queries of the layer rules and the remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import geo as G
from netloom.functions import text as T
from netloom.operators import graph as R
from netloom.operators import rules as K
from netloom.operators import topology as P
from netloom.operators.aggregates import verdict
from netloom.plans import relational as A
from netloom.plans import spatial_graph as S
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


def _status(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'PASS' ELSE 'FAIL' END"


@query(
    f"""WITH l(n) AS (VALUES ('boite'), ('cable'), ('ptech'), ('infrastructure'), ('site'), ('znro'), ('zpm'), ('imb')), o AS ({S.SQL['area_overlap']}), i AS ({S.SQL['named_region']}), b AS ({A.SQL['port_balance']}), v AS ({A.SQL['domain_vocabulary']}), r AS (
SELECT '1.1' rule_id, 'C' severity, count(*) FILTER (WHERE t.table_name IS NULL) n_violations, count(*) n_evidence FROM l LEFT JOIN (SELECT DISTINCT table_name FROM information_schema.tables) t ON t.table_name = l.n UNION ALL SELECT '1.9', 'E', count(*) FILTER (WHERE len(ring) < 3), count(*) FROM zpm WHERE ring IS NOT NULL UNION ALL SELECT '2.0', 'C', count(*) FILTER (WHERE c IS NULL OR c <> '3857') + greatest(count(DISTINCT c) - 1, 0), count(*) FROM (SELECT nullif(regexp_extract(s, '([0-9]+)$', 1), '') c FROM (VALUES ('EPSG:3857'), ('3857'), (NULL)) v(s)) UNION ALL SELECT '3.0', 'C', count(*) FILTER (WHERE n = 0), count(*) FROM (SELECT count(*) n FROM boite UNION ALL SELECT count(*) FROM site UNION ALL SELECT count(*) FROM information_schema.tables WHERE table_name = 'cable')
UNION ALL SELECT '6.2', 'E', (SELECT count(*) FROM o), (SELECT count(*) FROM zpm WHERE len(ring) >= 3) UNION ALL SELECT '6.3', 'E', (SELECT count(*) FROM i), (SELECT count(*) FROM boite WHERE type = 'PBO' AND x IS NOT NULL AND y IS NOT NULL)
UNION ALL SELECT '7.2', 'E', (SELECT count(*) FROM b WHERE diff > 0), (SELECT count(*) FROM b) UNION ALL SELECT 'domain_vocab', 'W', (SELECT count(*) FROM v), (SELECT count(*) FROM boite))
SELECT rule_id, severity, {_status('n_violations')} status, n_violations, n_evidence FROM r"""
)
def layer_rules(spark: SparkSession, d: str) -> DataFrame:
    layers = {n: table(spark, d, n) for n in ("boite", "site", "znro", "zpm")}
    z = V.area(spark, d)
    kinds = layers["zpm"].where("ring IS NOT NULL").select(G.wkt_type(F.when(F.size("ring") < 3, G.wkt_linestring(F.col("ring"))).otherwise(G.wkt_polygon(F.col("ring")))).alias("kind"))
    pbo = layers["boite"].where("type = 'PBO'").select(F.col("ref_pm").alias("key"), F.col("capacite").alias("value"))
    return K.report(
        [
            K.layers_present(spark, layers, [c.lower() for c in A.CLASSES]),
            K.geometry_types("1.9", kinds, "kind", ["Polygon", "MultiPolygon"]),
            K.one_crs(spark, {"boite": "EPSG:3857", "site": "3857", "zpm": None}, "EPSG:3857"),
            K.not_empty(layers, ["boite", "site", "cable"], spark),
            K.no_overlap("6.2", z, "id", "ring", 500.0),
            K.inside("6.3", V.site(spark, d), "id", "ref", z, "code", "ring"),
            K.balanced("7.2", pbo, layers["zpm"].select(F.col("code").alias("key"), F.col("nb_prises").alias("value")), "key"),
            K.vocabulary("domain_vocab", layers["boite"], A.VOCABULARY),
        ]
    )


@query()
def layer_verdict(spark: SparkSession, d: str) -> DataFrame:
    return verdict(layer_rules(spark, d)).select("errors", "warnings", "verdict")


SQL["layer_verdict"] = f"WITH r AS ({SQL['layer_rules']}) SELECT count(*) FILTER (WHERE status <> 'PASS' AND severity IN ('C', 'E')) errors, count(*) FILTER (WHERE status <> 'PASS' AND severity = 'W') warnings, CASE WHEN count(*) FILTER (WHERE status <> 'PASS' AND severity IN ('C', 'E')) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status <> 'PASS' AND severity = 'W') > 0 THEN 'QUARANTINE' ELSE 'PASS' END verdict FROM r"
_V = f"WITH {V.SQL_VIEWS}"


@query(_V + ", b AS (SELECT id, max(x) - min(x) w, max(y) - min(y) h, bool_or(abs(x) < 1e-9 AND abs(y) < 1e-9) o FROM pt GROUP BY id) SELECT id, w > 900 OR h > 900 wide, greatest(w, h) > 950 OR (o AND greatest(w, h) > 10) frame FROM b")
def line_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return V.line(spark, d).select("id", G.span_suspicious(F.col("points"), 900.0).alias("wide"), G.frame_artifact(F.col("points"), 950.0, 10.0).alias("frame"))


@query("SELECT s_suppkey id, round(6378137.0 * pi() / 180 * cos(radians((s_suppkey % 60) + 0.5)), 4) sx, round(6378137.0 * pi() / 180, 4) sy, round(500.0 / 111320, 9) tol FROM supplier")
def metric_scales(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("s_suppkey") % 60
    s = G.metric_scale(4326, m.cast("double"), m + 1.0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(s["x"], 4).alias("sx"), F.round(s["y"], 4).alias("sy"), F.round(F.lit(G.metres_to_units(500.0, True)), 9).alias("tol"))


@query("SELECT layer, CASE WHEN regexp_matches(lower(layer), 'chamber|manhole|handhole|pole|anchor|guy|vault|trench') THEN 'PTECH' WHEN regexp_matches(lower(layer), 'box|closure|fat|fdt|cto|nap|dp|mdu|sdu|ont|pedestal|cabinet|splice|splitter|patch|panel|terminal') THEN 'BOITE' WHEN regexp_matches(lower(layer), 'nro|pm|co|exchange|hub|pop|shelter|node') THEN 'SITE' ELSE 'PTECH' END class, CASE WHEN regexp_matches(lower(layer), 'fdt') THEN 'SITE' WHEN regexp_matches(lower(layer), '^fat\\s*sp$') THEN 'BOITE' END fragment, CAST(sum(CASE WHEN type = 'MTEXT' THEN 0 ELSE greatest(coalesce(length(text), 1), 1) END) AS BIGINT) weight FROM intermediate_pipeline_dump GROUP BY layer")
def block_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class and fragment target of the layers' names, and the weight of their entities."""
    e = table(spark, d, "intermediate_pipeline_dump")
    w = T.entity_weight(F.when(F.col("type") == "MTEXT", "annotation_copy"), F.length("text"))
    n = e.groupBy("layer").agg(F.sum(w).cast("bigint").alias("weight"))
    return n.select("layer", T.block_class(F.col("layer")).alias("class"), T.fragment_target(F.col("layer")).alias("fragment"), "weight")


@query("WITH RECURSIVE m AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) g, l_orderkey k FROM lineitem), e AS (SELECT DISTINCT a.g a, b.g b FROM m a JOIN m b USING (k)), reach(id, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id) SELECT id \"group\", min(r) merged FROM reach GROUP BY 1")
def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers linked by any order."""
    return R.merge_groups(table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("group"), F.col("l_orderkey").alias("member")))


@query("WITH u(code) AS (SELECT 'C' || o_custkey FROM orders UNION SELECT 'C' || o_custkey || '-S1' FROM orders WHERE o_custkey % 3 = 0 UNION SELECT 'C' || o_custkey || '-S3' FROM orders WHERE o_custkey % 4 = 0), r AS (SELECT o_orderkey chain, 'C' || o_custkey code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 k FROM orders), n AS (SELECT code, max(k) + 2 n FROM r GROUP BY 1), c AS (SELECT code, unnest(range(1, n + 1)) t FROM n), f AS (SELECT code, t, row_number() OVER (PARTITION BY code ORDER BY t) k FROM c WHERE code || '-S' || t NOT IN (SELECT code FROM u)) SELECT chain, r.code, CASE WHEN r.k = 0 THEN r.code ELSE r.code || '-S' || f.t END chain_code FROM r LEFT JOIN f ON f.code = r.code AND f.k = r.k")
def chain_codes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the chains of their customer, by price; some of the codes are in use."""
    o = table(spark, d, "orders")
    base = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    used = o.select(base.alias("code")).unionByName(o.where("o_custkey % 3 = 0").select(F.concat(base, F.lit("-S1")).alias("code"))).unionByName(o.where("o_custkey % 4 = 0").select(F.concat(base, F.lit("-S3")).alias("code")))
    return P.chain_codes(o.select(F.col("o_orderkey").alias("chain"), base.alias("code"), F.col("o_totalprice").alias("length")), "code", used).select("chain", "code", "chain_code")

"""Queries of the relational operators: references, counts, ledgers, rules, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import aggregates as A
from netloom.operators import joins as J
from netloom.operators import rules as R
from netloom.operators import windows as W
from netloom.functions.keys import ref_key
from netloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

FIELDS = {"boite": ["code", "code_ptc", "ref_plaque", "ref_pm", "type", "mode_pose", "fabriquant", "ref_bpe", "cable_amont", "statut", "proprietaire", "gestionnaire", "adressse", "ville"], "site": ["code", "ref_plaque", "ref_nro", "type", "fabriquant", "ref_produit", "mode_pose", "statut", "commune"], "zpm": ["code", "ref_plaque", "ref_nro", "ref_sro", "statut"]}
_T = "chr(32) || chr(9)"
_K = lambda c: f"nullif(upper(trim({c}, {_T})), '')"
_E = lambda c: f"({c} IS NULL OR trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)) = '')"


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(" UNION ALL ".join(f"SELECT '{t}' layer, '{c}' field, CAST(count(*) FILTER (WHERE {_E(c)}) AS BIGINT) n_empty FROM {t} HAVING count(*) FILTER (WHERE {_E(c)}) > 0" for t, cs in FIELDS.items() for c in cs))
def mandatory_nulls(spark: SparkSession, d: str) -> DataFrame:
    parts = [A.null_counts(table(spark, d, t), cs).select(F.lit(t).alias("layer"), "field", "n_empty") for t, cs in FIELDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT trim(code, chr(32)) code, CAST(count(*) AS BIGINT) n FROM boite WHERE trim(code, chr(32)) <> '' GROUP BY 1 HAVING count(*) > 1")
def code_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_codes(table(spark, d, "boite"), "code")


@query(f"WITH a AS (SELECT {_K('ref_pm')} k, sum(capacite) s FROM boite WHERE type = 'PBO' GROUP BY 1), b AS (SELECT {_K('code')} k, sum(nb_prises) s FROM zpm GROUP BY 1) SELECT coalesce(a.k, b.k) \"key\", CAST(coalesce(a.s, 0) AS BIGINT) left_sum, CAST(coalesce(b.s, 0) AS BIGINT) right_sum, CAST(coalesce(a.s, 0) - coalesce(b.s, 0) AS BIGINT) diff FROM (SELECT * FROM a WHERE k IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE k IS NOT NULL) b ON a.k = b.k")
def port_balance(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "boite").where("type = 'PBO'").select(F.col("ref_pm").alias("key"), F.col("capacite").alias("value"))
    return A.balance(left, table(spark, d, "zpm").select(F.col("code").alias("key"), F.col("nb_prises").alias("value")), "key")


@query(f"WITH a AS (SELECT DISTINCT {_K('code')} c FROM site WHERE type = 'PM' AND deleted_at IS NULL), b AS (SELECT DISTINCT {_K('code')} c FROM zpm) SELECT 'left' side, c code FROM a WHERE c IS NOT NULL AND c NOT IN (SELECT c FROM b WHERE c IS NOT NULL) UNION ALL SELECT 'right', c FROM b WHERE c IS NOT NULL AND c NOT IN (SELECT c FROM a WHERE c IS NOT NULL)")
def site_zone_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Sites in service without a zone and zones without one."""
    return J.isolation(table(spark, d, "site").where("type = 'PM' AND deleted_at IS NULL"), "code", table(spark, d, "zpm"), "code")


@query(f"WITH a AS (SELECT DISTINCT {_K('code')} c FROM site WHERE type = 'PM'), b AS (SELECT fid, {_K('ref_pm')} c FROM boite WHERE type = 'PBO') SELECT 'child' side, CAST(fid AS VARCHAR) item FROM b WHERE c IS NULL OR c NOT IN (SELECT c FROM a WHERE c IS NOT NULL) UNION ALL SELECT 'parent', c FROM a WHERE c IS NOT NULL AND c NOT IN (SELECT c FROM b WHERE c IS NOT NULL)")
def site_box_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Branching boxes without a site, also those that name none, and sites without a branching box."""
    return J.reference_isolation(table(spark, d, "site").where("type = 'PM'"), "code", table(spark, d, "boite").where("type = 'PBO'"), "fid", "ref_pm")


@query(f"WITH t AS (SELECT DISTINCT 'box' t, {_K('code')} c FROM boite UNION ALL SELECT DISTINCT 'site', {_K('code')} FROM site), e AS (SELECT fid edge_id, 'origin' AS \"end\", {_K('code_ptc')} ref FROM boite UNION ALL SELECT fid, 'upstream', {_K('cable_amont')} FROM boite UNION ALL SELECT fid, 'zone', {_K('ref_pm')} FROM boite) SELECT edge_id, \"end\", ref, CASE WHEN ref IS NULL THEN 'null' ELSE coalesce(m.t, 'nowhere') END found_in FROM e LEFT JOIN (SELECT c, min(t) t FROM t WHERE c IS NOT NULL GROUP BY c) m ON m.c = e.ref")
def endpoint_resolution(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boite")
    return J.resolve_endpoints(b, "fid", {"origin": "code_ptc", "upstream": "cable_amont", "zone": "ref_pm"}, {"box": J.code_set(b, "code"), "site": J.code_set(table(spark, d, "site"), "code")})


VOCABULARY = {"type": ["BPE", "PBO", "BPI", "PTO"], "mode_pose": ["FACADE", "CHAMBRE", "AERIEN"]}


@query(" UNION ALL ".join(f"SELECT '{f}' field, upper(trim({f}, chr(32))) AS value, CAST(count(*) AS BIGINT) n FROM boite WHERE trim({f}, chr(32)) <> '' AND upper(trim({f}, chr(32))) NOT IN ({', '.join(repr(v) for v in vs)}) GROUP BY 2" for f, vs in VOCABULARY.items()))
def domain_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return A.vocabulary_violations(table(spark, d, "boite"), VOCABULARY)


KINDS = {"code": "annotation-assigned", "c2": "synthetic", "capacite": "computed", "ville": "annotation-assigned"}


@query(" UNION ALL ".join(f"SELECT 'BOITE' fc, '{f}' field, '{k}' provenance, CAST(count(*) AS BIGINT) n FROM boite WHERE NOT {_E(f'CAST({f} AS VARCHAR)')}" for f, k in KINDS.items()))
def field_provenance(spark: SparkSession, d: str) -> DataFrame:
    return A.provenance(table(spark, d, "boite"), "BOITE", KINDS)


_BOX = ["code", "c2", "code_ptc", "capacite", "nb_splices", "ville", "adressse"]


@query("WITH a AS (" + " UNION ALL ".join(f"SELECT 'BOITE' fc, '{c}' field FROM boite HAVING count(*) FILTER (WHERE NOT {_E(f'CAST({c} AS VARCHAR)')}) > 0" for c in _BOX) + "), r AS (SELECT 'BOITE' fc, f field, p FROM (VALUES ('code', 'annotation-assigned'), ('c2', 'synthetic'), ('capacite', 'computed'), ('ville', 'annotation-assigned')) v(f, p) UNION ALL SELECT DISTINCT 'ZPM', 'statut', 'computed' FROM zpm WHERE statut IS NOT NULL) SELECT coalesce(a.fc, r.fc) fc, coalesce(a.field, r.field) field, CASE WHEN r.p IS NULL THEN 'missing' WHEN a.fc IS NULL THEN 'stale' WHEN r.p NOT IN ('annotation-assigned', 'computed') THEN 'unknown_kind' ELSE 'ok' END state FROM a FULL JOIN r ON a.fc = r.fc AND a.field = r.field")
def provenance_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the boxes that hold values against what field_provenance and a record of another layer say."""
    b = table(spark, d, "boite")
    actual = A.provenance(b, "BOITE", dict.fromkeys(_BOX, "any")).select("fc", "field")
    other = A.provenance(table(spark, d, "zpm"), "ZPM", {"statut": "computed"})
    recorded = field_provenance(spark, d).unionByName(other).select("fc", "field", "provenance")
    return A.provenance_coverage(actual, recorded, ["annotation-assigned", "computed"])


@query("WITH r AS (SELECT CASE WHEN fc_name IS NULL THEN 'unclassified' ELSE 'mapped' END disposition, layer, 1 n FROM intermediate_pipeline_dump WHERE fc_name IS DISTINCT FROM 'NEGATIVE_EVIDENCE' UNION ALL SELECT 'negative_evidence', layer, 1 FROM intermediate_pipeline_dump WHERE fc_name = 'NEGATIVE_EVIDENCE') SELECT disposition, layer, CAST(sum(n) AS BIGINT) n FROM r GROUP BY 1, 2")
def conservation_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intermediate_pipeline_dump")
    kept = e.where("fc_name IS DISTINCT FROM 'NEGATIVE_EVIDENCE'").select(F.when(F.col("fc_name").isNull(), "unclassified").otherwise("mapped").alias("disposition"), "layer", F.lit(1).alias("weight"))
    drops = A.top_counts(e.where("fc_name = 'NEGATIVE_EVIDENCE'").select(F.lit("negative_evidence").alias("port"), "layer"), ["port", "layer"])
    return A.conservation(kept, drops, ["aggregated"])


@query("WITH e AS (SELECT count(*) n, count(*) FILTER (WHERE fc_name = 'NEGATIVE_EVIDENCE') dropped FROM intermediate_pipeline_dump) SELECT 'all' ledger, n total, n expected, n = n ok FROM e UNION ALL SELECT 'kept', n - dropped, n, dropped = 0 FROM e")
def conservation_sum(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger against the rows read, and one that forgot the drops."""
    ledger, n = conservation_ledger(spark, d), table(spark, d, "intermediate_pipeline_dump").count()
    check = lambda name, df: A.conservation_check(df, n).select(F.lit(name).alias("ledger"), "*")
    return check("all", ledger).unionByName(check("kept", ledger.where("disposition <> 'negative_evidence'")))


@query("SELECT layer, type, CAST(count(*) AS BIGINT) n FROM intermediate_pipeline_dump GROUP BY 1, 2 ORDER BY n DESC, layer, type LIMIT 5")
def drop_accounting(spark: SparkSession, d: str) -> DataFrame:
    return A.top_counts(table(spark, d, "intermediate_pipeline_dump"), ["layer", "type"], 5)


CLASSES = ["BOITE", "CABLE", "PTECH", "INFRASTRUCTURE", "SITE", "ZNRO", "ZPM", "IMB"]


@query(f"WITH c AS (SELECT unnest({CLASSES}) fc_name) SELECT c.fc_name, CAST(count(e.entity_id) AS BIGINT) n, CAST(count(*) FILTER (WHERE abs(cx) < 100000) AS BIGINT) outliers, CASE WHEN count(e.entity_id) > 0 THEN 0.9::DOUBLE END confidence, CASE WHEN count(e.entity_id) = 0 THEN 'empty in the source' ELSE '' END note FROM c LEFT JOIN intermediate_pipeline_dump e USING (fc_name) GROUP BY 1")
def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intermediate_pipeline_dump").select("fc_name", (F.abs("cx") < 100_000).alias("geographic_outlier"), F.lit(0.9).alias("classification_confidence"))
    q = A.qc_summary(e, CLASSES)
    return q.withColumn("confidence", F.round("confidence", 6))


@query(f"WITH c AS (SELECT code k, {_K('ref_pm')} t, statut FROM boite), s AS (SELECT DISTINCT {_K('code')} c FROM site) SELECT 'bad_status' problem, count(*) n FROM c WHERE statut IS NULL OR statut NOT IN ('DEPLOYE', 'EN PROJET') UNION ALL SELECT 'several_selected', count(*) FROM (SELECT k FROM c WHERE t IS NOT NULL GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'unresolved_code', count(*) FROM c WHERE t IS NOT NULL AND t NOT IN (SELECT c FROM s WHERE c IS NOT NULL)")
def candidate_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The boxes' PM references as candidates: a box delivered again is selected several times."""
    c = table(spark, d, "boite").select(F.col("code").alias("annotation_key"), F.col("ref_pm").alias("target_code"), ref_key("ref_pm").isNotNull().cast("int").alias("selected"), F.col("statut").alias("status"))
    return A.candidate_consistency(c, table(spark, d, "site").select("code"), ["DEPLOYE", "EN PROJET"])


@query("WITH c AS (SELECT source_dwg, layer, count(*) n FROM intermediate_pipeline_dump WHERE layer IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_dwg ORDER BY n DESC, layer) k FROM c) SELECT source_dwg, layer, CAST(n AS BIGINT) n FROM r WHERE k = 1")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return A.majority(table(spark, d, "intermediate_pipeline_dump"), ["source_dwg"], "layer")


@query("WITH r AS (SELECT source_dwg, cy, row_number() OVER (PARTITION BY source_dwg ORDER BY cy) k, count(*) OVER (PARTITION BY source_dwg) n FROM intermediate_pipeline_dump WHERE cy IS NOT NULL) SELECT source_dwg, cy median, n FROM r WHERE k = n // 2 + 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return A.upper_median(table(spark, d, "intermediate_pipeline_dump"), ["source_dwg"], "cy")


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) q_10, round(quantile_cont(value, 0.5), 6) q_50, round(quantile_cont(value, 0.9), 6) q_90 FROM events GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = A.quantiles(table(spark, d, "events"), ["event_type"], "value", [0.1, 0.5, 0.9])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("q_10", "q_50", "q_90")])


@query(f"SELECT '4.3' rule_id, 'E' severity, CASE WHEN sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'FAIL' END status, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) n_violations, (SELECT count(*) FROM boite) n_evidence FROM ({' UNION ALL '.join(f'SELECT count(*) FILTER (WHERE {_E(c)}) n FROM boite' for c in FIELDS['boite'])}) UNION ALL SELECT '4.4', 'E', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), (SELECT count(*) FROM boite) FROM (SELECT 1 FROM boite WHERE trim(code, chr(32)) <> '' GROUP BY trim(code, chr(32)) HAVING count(*) > 1) UNION ALL SELECT 'fk', 'E', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), (SELECT count(*) FROM zpm) FROM (SELECT DISTINCT {_K('ref_nro')} c FROM zpm) WHERE c IS NOT NULL AND c NOT IN (SELECT {_K('ref_nro')} FROM znro WHERE {_K('ref_nro')} IS NOT NULL) UNION ALL SELECT '7.1', 'E', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), (SELECT count(*) FROM boite WHERE nb_fibre_util IS NOT NULL AND capacite IS NOT NULL) FROM boite WHERE nb_fibre_util > capacite")
def acceptance_rules(spark: SparkSession, d: str) -> DataFrame:
    b, z = table(spark, d, "boite"), table(spark, d, "zpm")
    return R.report([R.mandatory("4.3", b, FIELDS["boite"]), R.unique("4.4", b, "code"), R.foreign_key("fk", z, "ref_nro", table(spark, d, "znro"), "ref_nro"), R.at_most("7.1", b, "nb_fibre_util", "capacite")])


@query(f"WITH r AS ({SQL['acceptance_rules']}), n AS (SELECT count(*) FILTER (WHERE status <> 'PASS' AND severity IN ('C', 'E')) errors, count(*) FILTER (WHERE status <> 'PASS' AND severity = 'W') warnings, count(*) FILTER (WHERE status = 'PASS') rules_passed, count(*) FILTER (WHERE status <> 'PASS') rules_failed FROM r) SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'QUARANTINE' ELSE 'PASS' END verdict FROM n")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of the acceptance rules."""
    return A.verdict(acceptance_rules(spark, d))


@query("SELECT fid, code, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY fid) = 1 THEN code END kept_code FROM boite")
def first_occurrence_code(spark: SparkSession, d: str) -> DataFrame:
    return W.first_keeps_code(table(spark, d, "boite").select("fid", "code"), [], "code", ["fid"])


@query("WITH b AS (SELECT fid, type, CASE WHEN fid % 3 = 0 THEN NULL WHEN fid % 7 = 0 THEN 'BX' || lpad(CAST(fid % 50 AS VARCHAR), 4, '0') ELSE code END code FROM boite), n AS (SELECT type, count(*) n FROM b GROUP BY 1), e AS (SELECT type, unnest(range(1, n + 1)) i FROM n), f AS (SELECT type, i, row_number() OVER (PARTITION BY type ORDER BY i) k, CASE WHEN i > 9999 THEN 'BX' || i ELSE 'BX' || lpad(CAST(i AS VARCHAR), 4, '0') END c FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.type = e.type AND b.code = CASE WHEN i > 9999 THEN 'BX' || i ELSE 'BX' || lpad(CAST(i AS VARCHAR), 4, '0') END)), m AS (SELECT fid, type, row_number() OVER (PARTITION BY type ORDER BY fid) k FROM b WHERE code IS NULL) SELECT fid, type, code, code full_code FROM b WHERE code IS NOT NULL UNION ALL SELECT m.fid, m.type, NULL, f.c FROM m LEFT JOIN f ON f.type = m.type AND f.k = m.k")
def synthetic_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("fid") % 3 == 0, None).when(F.col("fid") % 7 == 0, F.concat(F.lit("BX"), F.lpad((F.col("fid") % 50).cast("string"), 4, "0"))).otherwise(F.col("code"))
    return W.synthetic_codes(table(spark, d, "boite").select("fid", "type", code.alias("code")), "type", "code", ["fid"], F.lit("BX"))


@query("SELECT o_orderkey, c, CASE WHEN k = 1 THEN c ELSE c || '-' || k END unique_code FROM (SELECT o_orderkey, 'C' || o_custkey c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) k FROM orders)")
def unique_suffixes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("c"))
    return W.unique_suffixes(o, [], "c", ["o_orderkey"])


@query()
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    w = W.gaps_and_islands(e, ["user_id"], "u", F.lit(3600 * 1_000_000))
    return w.select("user_id", "event_id", "island")


SQL["gap_islands"] = "WITH s AS (SELECT user_id, event_id, epoch_us(ts) u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END n FROM events) SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY u, event_id) AS BIGINT) island FROM s"


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity d FROM lineitem), r AS (SELECT *, row_number() OVER w k, lead(d) OVER w second_distance FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY d, l_linenumber)) SELECT l_orderkey, l_linenumber, d, second_distance, coalesce(second_distance - d <= 1, false) ambiguous FROM r WHERE k = 1")
def ambiguous_best_two(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("d"))
    return W.best_two(c, ["l_orderkey"], "d", ["l_linenumber"], 1.0)


_SCORES = "WITH s AS (SELECT l_suppkey % 50 c, l_partkey % 40 y, count(*) score, sum(l_linenumber) % 3 gap FROM lineitem GROUP BY 1, 2)"


@query(_SCORES + ", b AS (SELECT *, max(score) OVER (PARTITION BY c) m FROM s), t AS (SELECT *, count(*) OVER (PARTITION BY c) ties, rank() OVER (PARTITION BY c ORDER BY gap) g, min(y) OVER (PARTITION BY c) y0 FROM b WHERE score = m), h AS (SELECT c, score, ties, y0, count(*) FILTER (WHERE g = 1) one, min(y) FILTER (WHERE g = 1) y FROM t GROUP BY ALL), o AS (SELECT c, score, y0, CASE WHEN ties = 1 OR one = 1 THEN y END pick FROM h), p AS (SELECT *, max(score) OVER (PARTITION BY pick) top FROM o), q AS (SELECT *, count(*) FILTER (WHERE score = top) OVER (PARTITION BY pick) k FROM p) SELECT c, coalesce(pick, y0) y, score, CASE WHEN pick IS NULL THEN 'multiple_optima' WHEN k > 1 THEN 'contested_layout' WHEN score < top THEN 'outscored_on_layout' ELSE 'matched' END status FROM q")
def layout_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("c"), (F.col("l_partkey") % 40).alias("y")).agg(F.count(F.lit(1)).alias("score"), (F.sum("l_linenumber") % 3).alias("gap"))
    return W.match_both_ways(s, "c", "y", "score", "gap")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) k FROM orders) WHERE k = 1")
def representative_choice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return W.representative(o, ["o_custkey"], [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_totalprice"), F.col("o_orderkey")]).drop("o_orderpriority")


@query("SELECT fid, row_number() OVER (ORDER BY loaded_at, fid) new_id FROM boite")
def renumber(spark: SparkSession, d: str) -> DataFrame:
    return W.renumber(table(spark, d, "boite").select("fid", "loaded_at"), ["loaded_at", "fid"], "new_id").select("fid", "new_id")


@query(f"SELECT count(*) FILTER (WHERE a AND b) both_sets, count(*) FILTER (WHERE a AND NOT b) left_only, count(*) FILTER (WHERE b AND NOT a) right_only FROM (SELECT k, bool_or(s = 1) a, bool_or(s = 2) b FROM (SELECT 1 s, {_K('ref_pm')} k FROM boite UNION ALL SELECT 2, {_K('ref_sro')} FROM zpm) WHERE k IS NOT NULL GROUP BY k)")
def code_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = J.code_set(table(spark, d, "boite"), "ref_pm").withColumn("a", F.lit(True)), J.code_set(table(spark, d, "zpm"), "ref_sro").withColumn("b", F.lit(True))
    j = a.join(b, "code", "full_outer")
    n = lambda cond: F.count_if(F.expr(cond))
    return j.agg(n("a AND b").alias("both_sets"), n("a AND b IS NULL").alias("left_only"), n("b AND a IS NULL").alias("right_only"))

"""Writers: layers, evidence tables, quarantine, styles and reports."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.aggregates import conservation_check
from netloom.session import path_exists

#: Rows that the single-file exports may have: they go through the driver.
EXPORT_ROWS = 1_000_000


def write_layers(features: DataFrame, path: str, by: str = "fc_name") -> None:
    """One partition folder for each class; a repartition on the class keeps the number of files small."""
    features.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """The whole table anew; writing twice gives the same."""
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_evidence(path: str, ledger: DataFrame, expected: int, candidates: DataFrame | None = None, provenance: DataFrame | None = None, strict: bool = False) -> bool:
    """Ledger with its expected total as a row of its own, candidates and provenance; True if the total is right, an error if not and strict."""
    ok = bool(conservation_check(ledger, expected).first()["ok"])
    if strict and not ok:
        raise ValueError(f"the ledger doesn't sum to {expected}")
    meta = ledger.sparkSession.createDataFrame([("__expected_total__", "", expected)], "disposition string, layer string, n long")
    replace_table(ledger.select("disposition", "layer", F.col("n").cast("long")).unionByName(meta), f"{path}/conservation_ledger")
    for name, df in (("annotation_assignment_candidates", candidates), ("field_provenance", provenance)):
        if df is not None:
            replace_table(df, f"{path}/{name}")
    return ok


def read_table(spark, path: str) -> DataFrame | None:
    """A table, or None if it isn't there."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def style_xml(categories: list[tuple[str, str, int]]) -> str:
    """Categorised style of (key, rgba, n)."""
    items = "".join(f'<category value={quoteattr(k)} symbol="{i}" label={quoteattr(f"{k} ({n})")}/>' for i, (k, _, n) in enumerate(categories))
    symbols = "".join(f'<symbol name="{i}"><prop k="color" v={quoteattr(c)}/></symbol>' for i, (_, c, _) in enumerate(categories))
    return f'<qgis><renderer-v2 type="categorizedSymbol" attr="style_key"><categories>{items}</categories><symbols>{symbols}</symbols></renderer-v2></qgis>'


def write_styles(histogram: DataFrame, folder: str) -> dict:
    """A style file for each layer of (layer, style_key, rgba, n) and a manifest with their SHA-256; style keys are a closed set, collected."""
    import hashlib

    out: dict = {}
    if (n := histogram.count()) > EXPORT_ROWS:
        raise ValueError(f"{n} style categories: too many for style files")
    rows = histogram.orderBy("layer", F.desc("n"), "style_key").collect()
    Path(folder).mkdir(parents=True, exist_ok=True)
    for layer in dict.fromkeys(r["layer"] for r in rows):
        xml = style_xml([(r["style_key"], r["rgba"], r["n"]) for r in rows if r["layer"] == layer])
        Path(folder, f"{layer}.qml").write_text(xml, encoding="utf-8")
        out[layer] = {"sha256": hashlib.sha256(xml.encode()).hexdigest(), "categories": sum(r["layer"] == layer for r in rows)}
    Path(folder, "manifest.json").write_text(json.dumps(out, sort_keys=True), encoding="utf-8")
    return out


def export_sqlite(df: DataFrame, path: str, name: str) -> int:
    """A table of at most EXPORT_ROWS rows into an SQLite file, row by row through the driver; larger ones are refused."""
    n = df.count()
    if n > EXPORT_ROWS:
        raise ValueError(f"{n} rows: write Parquet instead")
    cols = df.columns
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{name}"')
        con.execute(f'CREATE TABLE "{name}" ({", ".join(chr(34) + c + chr(34) for c in cols)})')
        plain = df.select(*[c if t in ("string", "int", "bigint", "double", "boolean") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
        con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(cols))})', (tuple(r) for r in plain.toLocalIterator()))
    return n


def report_json(rules: DataFrame, verdict: DataFrame) -> str:
    """A verification report; a row a rule."""
    body = {r["rule_id"]: {k: r[k] for k in ("severity", "status", "n_violations")} for r in rules.collect()}
    return json.dumps({"rules": body, "summary": verdict.first().asDict()}, sort_keys=True)

"""Drawing dumps, vocabularies and settings as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import path_exists

#: Entities that are no geometry, those read as geometry, and the dimension kinds (fixed values).
CONTROL = ["BLOCK", "ENDBLK", "SEQEND", "ATTDEF"]
GEOMETRY = ["LINE", "LWPOLYLINE", "CIRCLE", "ARC", "TEXT", "MTEXT", "ATTRIB", "INSERT", "POINT"]
OBJECT = "object string, entity string, name string, handle array<long>, layer array<long>, layout_name string, tab_order int, block_header array<long>, entities array<array<long>>, attribs array<array<long>>, tag string, text_value string, ins_pt array<double>, entmode int, ownerhandle array<long>, color struct<rgb:long,index:int>, ltype array<long>"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON dumps, one row each, with `h`, their own handle; unknown keys are left out."""
    dump = spark.read.json(path, schema=f"OBJECTS array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in _fields(OBJECT))}>>", multiLine=True)
    return dump.select(F.explode("OBJECTS").alias("o")).select("o.*", handle(F.col("o.handle")).alias("h"))


def _fields(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def handle(ref: Column) -> Column:
    """The handle a reference ends in."""
    return F.try_element_at(ref, F.lit(-1))


def layer_table(objs: DataFrame) -> DataFrame:
    """(h, layer, aci, truecolor, linetype): layers with their colour, indices out of range as 7, and line type."""
    from netloom.functions.colour import unpack

    kinds = objs.where("object = 'LTYPE'").select(F.col("h").alias("lt"), F.col("name").alias("lname"))
    c = unpack(F.coalesce(F.col("color.rgb"), F.lit(0)), F.coalesce(F.col("color.index"), F.lit(256)))
    lay = objs.where("object = 'LAYER'").select("h", F.col("name").alias("layer"), c.alias("c"), handle(F.col("ltype")).alias("lt")).join(kinds, "lt", "left")
    plain = F.col("lname").isNull() | F.lower("lname").isin("bylayer", "byblock")
    return lay.select("h", "layer", F.when(F.col("c.aci").between(1, 255), F.col("c.aci")).otherwise(7).alias("aci"), F.col("c.truecolor").alias("truecolor"), F.when(plain, "Continuous").otherwise(F.col("lname")).alias("linetype"))


def dispositions(entities: DataFrame) -> DataFrame:
    """entities (entity, entmode) with `port`: where each goes, NULL for geometry that is kept."""
    e, m = F.col("entity"), F.col("entmode")
    port = F.when(m == 0, "block_definition").when(m == 1, "paper_space").when(e.isin(CONTROL), "control_entity").when(e.startswith("DIMENSION"), "dimension").when(~e.isin(GEOMETRY), F.concat(F.lit("unsupported_type:"), e))
    return entities.withColumn("port", port)


def layouts(objs: DataFrame) -> DataFrame:
    """(layout_name, tab_order, block): layouts with the block that holds their entities."""
    return objs.where("object = 'LAYOUT'").select("layout_name", "tab_order", handle(F.col("block_header")).alias("block"))


def layout_entities(objs: DataFrame) -> DataFrame:
    """(layout_name, h, entity, text, block_name, attributes): the entities of each layout, texts and inserts with their attributes."""
    by = objs.select(F.col("h").alias("bh"), "entities")
    e = layouts(objs).join(by, F.col("block") == F.col("bh")).select("layout_name", F.explode("entities").alias("r")).select("layout_name", handle(F.col("r")).alias("h"))
    full = e.join(objs.select("h", "entity", "text_value", "name", "attribs"), "h")
    attr = full.select("layout_name", "h", F.explode_outer("attribs").alias("r")).select("layout_name", "h", handle(F.col("r")).alias("ah"))
    tags = attr.join(objs.select(F.col("h").alias("ah"), "tag", F.col("text_value").alias("v")), "ah").where("tag IS NOT NULL").groupBy("layout_name", "h", F.upper("tag").alias("tag")).agg(F.max("v").alias("v"))
    maps = tags.groupBy("layout_name", "h").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "v")))).alias("attributes"))
    return full.join(maps, ["layout_name", "h"], "left").select("layout_name", "h", "entity", F.col("text_value").alias("text"), F.col("name").alias("block_name"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def layout_facts(entities: DataFrame, id_tag: str = "FDT_ID", sequence_tag: str = "FAT_SEQUENCE") -> DataFrame:
    """(layout_name, ids, sequences, usable, reason): what a layout's attributes name; usable with one id and a sequence."""
    g = entities.groupBy("layout_name").agg(*[F.array_sort(F.collect_set(F.nullif(F.trim(F.try_element_at("attributes", F.lit(t))), F.lit("")))).alias(n) for t, n in ((id_tag, "ids"), (sequence_tag, "sequences"))])
    reason = F.when(F.size("ids") == 0, "no id").when(F.size("ids") > 1, "several ids").when(F.size("sequences") == 0, "no sequence").otherwise("")
    return g.withColumns({"usable": reason == "", "reason": reason})


def vocabulary(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """(value): first fields of a ;-separated file, upper case, in their first order; the fallback where there is no file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([(v.upper(),) for v in dict.fromkeys(fallback)], "value string")
    rows = spark.read.csv(path, sep=";", schema="value string").select(F.upper(F.trim("value")).alias("value"), F.monotonically_increasing_id().alias("k")).where("value <> ''")
    return rows.groupBy("value").agg(F.min("k").alias("k")).orderBy("k").select("value")


def json_settings(path: str, default: dict) -> dict:
    """A settings file, the default where it is missing or can't be read; a single wrapping key is taken off."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default
    return next(iter(data.values())) if isinstance(data, dict) and len(data) == 1 and isinstance(next(iter(data.values())), dict) else data


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(name, body): every JSON file of a folder by its stem; files that are no JSON have a NULL body."""
    text = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("name"), "value")
    return text.select("name", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("body"))


@dataclass(frozen=True)
class EngineConfig:
    """Tolerances in metres and patterns; never changed in place."""

    fragment_tol: float = 50.0
    link_tol: float = 15.0
    fusion_tol: float = 5.0
    snap: float = 5.0
    isolation: float = 30.0
    weld: float = 0.5
    expected_crs: str = "EPSG:3857"
    patterns: tuple = ()
    vocabularies: dict = field(default_factory=dict)

    def overlay(self, settings: dict) -> EngineConfig:
        """Settings over the defaults: plain values replace, patterns go before the present ones, vocabularies are united."""
        known = {k: v for k, v in settings.items() if k in self.__dataclass_fields__ and k not in ("patterns", "vocabularies")}
        words = {k: sorted(set(self.vocabularies.get(k, ())) | set(settings.get("vocabularies", {}).get(k, ()))) for k in {*self.vocabularies, *settings.get("vocabularies", {})}}
        return replace(self, **known, patterns=(*map(tuple, settings.get("patterns", ())), *self.patterns), vocabularies=words)

"""Classification and attributes from layer names and labels, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers that are never classified, patterns of layer names in the order they are tried with class and
# geometry, keyword groups of labels in order, attribute patterns, synonyms and label families.
NEGATIVE_LAYERS = ["APPROVAL", "APPROVAL MATRIX", "LEGEND", "CARTOUCHE", "TITLE", "TITLE BLOCK", "LEGENDE", "DEFPOINTS", "NORTH ARROW", "SCALE BAR", "GRID", "Base Map", "BASIC MAP", "BOM", "outline", "BOEDER", "mainlayer", "Fenetres ARCHICAD", "Portes ARCHICAD", "CARLAGE", "POMPIER", "fenêtres", "MURS 2", "DESIGN SUMMARY", "0"]
LAYER_PATTERNS = [
    (r"fat\s*area|boundary\s*fat|hp\s*cover|zpm|zone.*pm|zone.*sro|distribution.*zone|service.*zone", "ZPM", "Polygon"),
    (r"fdt", "SITE", "Point"),
    (r"\bfat\b|^nap|box|slimbox|blackbox|closure|cto|dp\b|ont|pedestal|splice|splitter|spliter|patch|panel|terminal|otb|fsc|boite|hw-fat", "BOITE", "Point"),
    (r"pole|poteau|chamber|chambre|manhole|handhole|anchor|guy\b|vault|ptech|gaine\s*technique|gc\s|appui|ancrage|hw-handhole|iam\s*mh", "PTECH", "Point"),
    (r"home\s*number|home\s*pass|building|batiment|premise|house|unit|apartment|office|mdu|sdu|imb|property|address|customer|subscriber|logement|maison|villa|immeuble|residence", "IMB", "Point"),
    (r"duct|conduit|pipe|trench|infra|pathway|route|buried|underground|aerial|fourreau|adduction|branchement|raccordement|gaine|new\s*duct|pit|handhole|chamber", "INFRASTRUCTURE", "LineString"),
    (r"cable|fib[er]*e|feeder|trunk|distribution|drop|riser|lateral|backbone|access|span\s*cable|micro\s*cable|loose\s*cable|sling\s*wire|suspension\s*wire|span\s*sling|sling|fo\s*\d+\s*core|fo\s*cable|service\s*core|expansion\s*core|moniter\s*core|monitor\s*core|^line$", "CABLE", "LineString"),
    (r"site|nro|pm\b|exchange|node|hub|pop\b|co\b|shelter|cabinet|location|olt|ftts|local.*tech", "SITE", "Point"),
    (r"znro|zone.*nro|olt.*zone|exchange.*zone|coverage|service.*area", "ZNRO", "Polygon"),
    (r"^eu$|^go\d*$|^go$", "PTECH", "Point"),
    (r"^pln$|^telkom$", "SITE", "Point"),
    (r"ftts.*site", "SITE", "Point"),
    (r"^text$|etik", "IMB", "Point"),
]
KEYWORDS = [
    (r"fibre|fiber|optic|box|closure|splice|cable|wire|drop", "CABLE"),
    (r"chamber|manhole|handhole|pole|anchor|guy|trench|vault", "PTECH"),
    (r"nro|pm|shelter|cabinet|exchange|node|hub|olt|splitter", "SITE"),
    (r"duct|conduit|pipe|trench|infra|buried|aerial|underground", "INFRASTRUCTURE"),
    (r"building|premise|house|home|unit|apartment|office|mdu|sdu", "IMB"),
    (r"zone|area|boundary|coverage|region|polygon|district", "ZNRO"),
]
ATTRIBUTES = {
    "NB_FIBRE_UTIL": r"(\d+)\s*FO",
    "CAPACITE": r"(\d+)\s*C(?!\w)",
    "MODE_POSE": r"(AERIAL|UNDERGROUND|BURIED|TRENCH|DUCT|DIRECT_BURIED|LASER_AIDED|MINI_TRENCH|MICRODUCT)",
    "TYPE_FIBRE": r"(G6\d{2}[A-Z0-9]*)",
    "TYPE_BOX": r"\b(FDT|FAT|CTO|NAP|DP|MDU|SDU|ONT)\b",
    "SITE_TYPE": r"\b(NRO|PM|CO|EXCHANGE|HUB|POP)\b",
    "STATUT": r"(DEPLOYED|PLANNED|IN_PROGRESS|UNDER_CONSTRUCTION|PROPOSED|BUILT|ACTIVE|INACTIVE)",
    "DIAMETRE": r"(\d+)\s*mm",
    "TYPE_CABLE": r"(TRUNK|FEEDER|DISTRIBUTION|DROP|RISER|LATERAL|BACKBONE|ACCESS)",
}
STATUS_SYNONYMS = {"IN_PROGRESS": "UNDER_CONSTRUCTION", "PLANNED": "PROPOSED"}
CABLE_SYNONYMS = {"TRUNK": "TRANSPORT", "BACKBONE": "TRANSPORT", "FEEDER": "TRANSPORT", "DISTRIBUTION": "DISTRIBUTION", "LATERAL": "DISTRIBUTION", "ACCESS": "DISTRIBUTION", "DROP": "RACCORDEMENT", "RISER": "VERTICALITE"}
FAMILIES = [(r"DMPH-\d+\.\d+\.[A-Z]\d{2}", "fat", "BOITE"), (r"MR\.DMPH\.P\d+", "pole", "PTECH"), (r"EXT\.MR\.\w+\.\w+\.\w+\.P\d+", "pole_ext", "PTECH")]
LAYOUT_ROLES = [(r"TOPOLOGY|SPLICING|SCHEMATIC|DIAGRAM", "topology"), (r"LEGEND|CABLE[ _-]*TYPE|SYMBOL", "legend"), (r"FDT[ _-]*LAYOUT|EQUIPMENT", "equipment"), (r"^(?:FDT[-_ ]?(?:ALL|\d+)|PLAN|NETWORK)", "plan")]
#: Parts of block names and the class they mean, in the order they are tried.
BLOCK_CLASSES = [
    (["chamber", "manhole", "handhole", "pole", "anchor", "guy", "vault", "trench"], "PTECH"),
    (["box", "closure", "fat", "fdt", "cto", "nap", "dp", "mdu", "sdu", "ont", "pedestal", "cabinet", "splice", "splitter", "patch", "panel", "terminal"], "BOITE"),
    (["nro", "pm", "co", "exchange", "hub", "pop", "shelter", "node"], "SITE"),
]
FRAGMENT_LAYERS = [(r"fdt", "SITE", "PM"), (r"^fat\s*sp$", "BOITE", "PBO")]
REPRESENTATIONS = {"INSERT": "block", "CIRCLE": "circle", "TEXT": "text", "MTEXT": "text", "ATTRIB": "text", "AGGREGATE": "fragment"}


def _plain_letters() -> tuple[str, str]:
    """Letters of Latin script with marks and the plain letter each is composed of, by the Unicode decomposition."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = _plain_letters()


def _first(c: Column, patterns: list[tuple], value: int) -> Column:
    """The value of the first pattern found, without regard to case; NULL if none is."""
    out = None
    for p in patterns:
        out = F.when(c.rlike(f"(?i){p[0]}"), p[value]) if out is None else out.when(c.rlike(f"(?i){p[0]}"), p[value])
    return out


def negative(layer: Column) -> Column:
    return F.lower(F.trim(layer)).isin([n.lower() for n in NEGATIVE_LAYERS])


def tier1(layer: Column) -> Column:
    """Class of a layer name: fc_misc on negative evidence, else by the first pattern; NULL if none fits."""
    return F.when(negative(layer), "fc_misc").otherwise(_first(layer, LAYER_PATTERNS, 1))


def tier1_geometry(layer: Column) -> Column:
    """Geometry type that goes with the class of tier1; NULL where there is none."""
    return F.when(~negative(layer), _first(layer, LAYER_PATTERNS, 2))


def tier2(text: Column) -> Column:
    return _first(text, KEYWORDS, 1)


def assign_class(one: Column, two: Column) -> Column:
    """struct(fc_name, confidence, method) from the classes that layer (tier1) and label (tier2) give, columns of their own: layer first."""
    pick = lambda a, b, c, d: F.when(one == "fc_misc", a).when(one.isNotNull(), b).when(two.isNotNull(), c).otherwise(d)
    return F.struct(pick(F.lit("fc_misc"), one, two, F.lit("fc_misc")).alias("fc_name"), pick(F.lit(1.0), F.lit(0.9), F.lit(0.5), F.lit(0.0)).alias("confidence"), pick(F.lit("negative_evidence"), F.lit("tier1_layer_pattern"), F.lit("tier2_annotation_keyword"), F.lit("unclassified")).alias("method"))


def _synonym(c: Column, table: dict[str, str]) -> Column:
    out = c
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def attributes(text: Column) -> Column:
    """map of the attributes a label states; a site type overrides a box type."""
    found = {k: F.nullif(F.upper(F.regexp_extract(text, f"(?i){p}", 1)), F.lit("")) for k, p in ATTRIBUTES.items()}
    found["TYPE"] = F.coalesce(found.pop("SITE_TYPE"), found.pop("TYPE_BOX"))
    found["STATUT"] = _synonym(found["STATUT"], STATUS_SYNONYMS)
    found["TYPE_CABLE"] = _synonym(found["TYPE_CABLE"], CABLE_SYNONYMS)
    for k in ("NB_FIBRE_UTIL", "CAPACITE", "DIAMETRE"):
        found[k] = found[k].try_cast("int").cast("string")
    return F.map_filter(F.create_map(*[x for k in sorted(found) for x in (F.lit(k), found[k])]), lambda k, v: v.isNotNull())


def family(text: Column) -> Column:
    """Label family whose pattern the whole text fits; the first wins."""
    return _first(text, [(f"(?-i)^(?:{p})$", f, t) for p, f, t in FAMILIES], 1)


def family_target(fam: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, f, t in FAMILIES:
        out = F.when(fam == f, t).otherwise(out)
    return out


def representation(kind: Column) -> Column:
    out = F.lit("outline")
    for k, v in REPRESENTATIONS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def layout_role(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(n) == "model", "model").otherwise(F.coalesce(_first(n, LAYOUT_ROLES, 1), F.lit("other")))


def layout_disposition(name: Column) -> Column:
    role = layout_role(name)
    return F.when(role == "model", "geometry_source").when(role == "plan", "fdt_tagging").when((role == "topology") & ~name.rlike("(?i)SPLICING"), "evidence").otherwise("exclude")


def fragment_target(layer: Column) -> Column:
    return _first(layer, FRAGMENT_LAYERS, 1)


def clean_code(text: Column) -> Column:
    """Upper case, white space to -, letters, digits, - and _ only, 40 characters; NULL if nothing is left."""
    c = F.regexp_replace(F.trim(F.regexp_replace(F.upper(text), F.lit(r"\s+"), F.lit(" "))), F.lit(" "), F.lit("-"))
    return F.nullif(F.substring(F.regexp_replace(c, F.lit(r"[^\p{L}\p{N}_-]"), F.lit("")), 1, 40), F.lit(""))


def normalised(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" "))))


def unaccented(text: Column) -> Column:
    """Upper case, letters without their marks; what is then beyond ASCII falls away."""
    return F.regexp_replace(F.translate(F.upper(text), ACCENTED, PLAIN), F.lit("[^\\x00-\\x7F]"), F.lit(""))


def is_numeric(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, F.lit("[, ]"), F.lit("")).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def semantic_score(text: Column, patterns: Column) -> Column:
    """0 without a text, 0.3 without patterns, 0.1 if none is found, else 0.3 and 0.7 times the share found; patterns: array<string>."""
    hits = F.size(F.filter(patterns, lambda p: F.regexp_like(text, p)))
    n = F.coalesce(F.size(patterns), F.lit(0))
    return F.when(text.isNull() | (text == ""), 0.0).when(n <= 0, 0.3).when(hits == 0, 0.1).otherwise(F.least(F.lit(1.0), 0.3 + 0.7 * hits / n))


def safe_layer_name(name: Column) -> Column:
    """ASCII word characters, no leading digit, 50 characters."""
    c = F.regexp_replace(name, F.lit(r"[^A-Za-z0-9_]"), F.lit("_"))
    return F.substring(F.when(c.rlike("^[0-9]"), F.concat(F.lit("L_"), c)).otherwise(c), 1, 50)


def regime_hint(y: Column) -> Column:
    return F.when(y > 101_000, "A").when(y < 99_000, "B").otherwise("UNKNOWN")


def endpoint_grade(d: Column, snap: float, isolation: float) -> Column:
    return F.when(d.isNull() | (d > isolation), "FLOATING").when(d <= snap, "SNAP").otherwise("ATTR_ONLY")


def block_class(name: Column) -> Column:
    """Class of a block's name by the first list with a word it holds, PTECH otherwise."""
    return F.coalesce(_first(name, [("|".join(words), fc) for words, fc in BLOCK_CLASSES], 1), F.lit("PTECH"))


def entity_weight(method: Column, count: Column) -> Column:
    """Drawing entities a feature stands for: none for a copied annotation, else its count, one at least."""
    return F.when(method == "annotation_copy", 0).otherwise(F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)))

"""Colours of drawings."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column
from pyspark.sql import functions as F

BYLAYER, BYBLOCK, DEFAULT_INDEX, UNKNOWN_RGB = 256, 0, 7, "#404040"
#: Colours of the indices outside the hue wheel (fixed values); index 7 is black on a white page.
FIXED_RGB = {1: "#FF0000", 2: "#FFFF00", 3: "#00FF00", 4: "#00FFFF", 5: "#0000FF", 6: "#FF00FF", 7: "#000000", 8: "#414141", 9: "#808080", 250: "#333333", 251: "#5B5B5B", 252: "#848484", 253: "#ADADAD", 254: "#D6D6D6", 255: "#FFFFFF"}
#: Brightness of the five steps of each hue (fixed values).
STEPS = (255, 204, 153, 127, 76)


def palette() -> dict[int, str]:
    """Index colours: 24 hues of 15 degrees, five steps of brightness each, full and half saturation in turn."""
    out = dict(FIXED_RGB)
    for index in range(10, 250):
        hue, place = divmod(index - 10, 10)
        rgb = colorsys.hsv_to_rgb(hue / 24, 0.5 if place % 2 else 1.0, STEPS[place // 2] / 255)
        out[index] = "#" + "".join(f"{int(v * 255):02X}" for v in rgb)
    return out


def index_rgb(aci: Column) -> Column:
    """Colour of an index by a literal map of 255 entries."""
    table = F.create_map(*[F.lit(x) for kv in sorted(palette().items()) for x in kv])
    return F.coalesce(F.try_element_at(table, aci.cast("int")), F.lit(UNKNOWN_RGB))


def unpack(raw: Column, index: Column) -> Column:
    """struct(aci, truecolor) of a packed colour: high byte C2 carries RGB, C3 an index, anything else leaves the index."""
    kind = F.shiftrightunsigned(raw.cast("bigint"), 24).bitwiseAND(F.lit(255))
    low = raw.cast("bigint").bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    return F.struct(F.when(kind == 0xC3, low.bitwiseAND(F.lit(255))).otherwise(index).alias("aci"), F.when(kind == 0xC2, low).alias("truecolor"))


def rgb_text(truecolor: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(truecolor.cast("bigint").bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))


def effective(aci: Column, truecolor: Column, linetype: Column, layer_aci: Column, layer_truecolor: Column, layer_linetype: Column) -> Column:
    """struct(color_aci, color_rgb, style_key): true colour before index, by-layer and by-block from the layer, indices out of range as 7."""
    inherits = truecolor.isNull() & aci.isin(BYLAYER, BYBLOCK)
    own_aci = F.when(inherits, F.coalesce(layer_aci, F.lit(DEFAULT_INDEX))).otherwise(aci)
    own_true = F.when(inherits, layer_truecolor).otherwise(truecolor)
    shown = F.when(own_true.isNull() & ~F.coalesce(own_aci.between(1, 255), F.lit(False)), F.lit(DEFAULT_INDEX)).otherwise(own_aci)
    rgb = F.when(own_true.isNotNull(), rgb_text(own_true)).otherwise(index_rgb(shown))
    style = F.concat_ws("|", rgb, F.coalesce(F.nullif(linetype, F.lit("")), F.nullif(layer_linetype, F.lit("")), F.lit("Continuous")))
    return F.struct(shown.alias("color_aci"), rgb.alias("color_rgb"), style.alias("style_key"))


def rgb_last_six(text: Column) -> Column:
    """#RRGGBB of a hex text, the last six digits of eight."""
    digits = F.upper(F.regexp_extract(text, r"([0-9A-Fa-f]{6})$", 1))
    return F.when(digits != "", F.concat(F.lit("#"), digits))


def rgba(rgb: Column) -> Column:
    """R,G,B,255 of #RRGGBB; 64,64,64,255 of anything else."""
    part = lambda i: F.conv(F.substring(rgb, i, 2), 16, 10)
    return F.when(rgb.rlike("^#[0-9A-Fa-f]{6}$"), F.concat_ws(",", part(2), part(4), part(6), F.lit("255"))).otherwise("64,64,64,255")


def pen(linetype: Column) -> Column:
    """Pen of a line type's name."""
    name = F.upper(F.coalesce(linetype, F.lit("")))
    return F.when(name.rlike("DASHDOT|CENTER|PHANTOM"), "dash dot").when(name.rlike("DOT"), "dot").when(name.rlike("DASH|HIDDEN"), "dash").otherwise("solid")

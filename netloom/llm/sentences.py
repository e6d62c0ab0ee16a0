"""Sentence boundaries across languages and scripts (problem 8), in SQL expressions only.

A text becomes blocks (paragraphs; fenced and indented code falls away), blocks become items (list items and quoted
lines without their marks), and items become sentences. Within an item every mark that can't end a sentence is
masked by a private-use character, one for one, so positions hold: marks in inline code and URLs, in decimals,
versions and file names, after initials and abbreviations. The masked item is split after script-specific
terminators; a sentence's text is then taken from the unmasked text by its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that may be masked and the private-use characters that stand for them.
MARKS = ".?!…。！？"
MASKS = "\ue000\ue001\ue002\ue003\ue004\ue005\ue006"
DOT = MASKS[0]

#: Abbreviations that are followed by what they belong to and end no sentence.
TITLES = (
    "inst prof dr mr mrs Prof Dr Drs Mr Mrs Ms Mme Mlle MM St Ste Sr Sra Srta Hr Fr Ing Dipl Inst Jl Gg Bpk Gen Col Capt Lt Sgt Hon "
    "cf Cf vgl Vgl vs viz approx Approx aprox Aprox ca Ca env Env bzw inkl exkl incl "
    "réf Réf bd Bd boul av Av bld chap "
    "ул Ул гл пл пер обл им проф акад См напр тел "
    "hlm tgl डॉ श्री पं नं د"
).split()
#: Abbreviations that end no sentence where a number or a lone letter follows.
NUMBERED = "tol Tol Vers No no Nos nos NO Nr Nrn nr N n Fig Figs fig figs Sec sec Secs secs Ch ch Eq eq Tab tab Vol vol p P pp S s v V ver Ver vers rev Rev pos Pos art Art Abs Abb Kap Bl Ziff núm Núm pág págs п пп г гг д кв корп с стр рис Рис табл № hal bab lin op ext ref Ref".split()
#: Abbreviations of several parts; their parts end no sentence.
PHRASES = "i.e e.g p.ex p.ej z.B Z.B d.h D.h u.a u.U o.ä z.T s.o s.u т.е т.к т.н т.о N.B a.C d.C c.-à-d".split()
#: Abbreviations that may stand at the end; they end a sentence only before an upper-case letter or one without case.
MAYBE = "ft min hr hrs lbs oz etc usw dsb dst dll al Inc Ltd Co Corp Bros Jr др пр".split()
#: Words before a German day or ordinal.
ORDINAL = "am Am im Im der Der die Die das Das den Den dem Dem des zum Zum zur Zur vom Vom beim Beim bis seit ab Ab jeder jede".split()
#: Words before a lone letter that is a name, no initial.
LETTERED = "Annexe Anhang Anexo Appendix annexe appendix plan Plan Option option type Type zone Zone".split()
#: Full stops of scripts that write other marks: Devanagari, Arabic, Armenian, Ethiopic, Khmer, Burmese, Tibetan, Tifinagh, Mongolian, Javanese and others (fixed values).
STOPS = "।॥؟۔։።፧፨។៕။༎།᙮᠃᠉᥄᥅᪨᭞꛳꡶꣎꧈꩝꯫"
#: Particles that close a Thai sentence before a space.
THAI = "ครับ ค่ะ คะ จ้ะ จ๊ะ".split()

_W = "[\\s\u00a0\u202f\u3000]"
_B = "(?<![\\p{L}\\p{M}\\p{N}_])"  # no word before
_CLOSE = "\"”“’'»›)\\]）】」』》〉"
_TERM = ".!?…"


def _alt(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", "\\.") for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


BLOCKS = (
    "(?s:(?<![^\\n])[ ]{0,3}```.*?(?:\\n[ ]{0,3}```[ \\t]*(?=\\n|\\z)|\\z))"
    "|(?s:(?<![^\\n])[ ]{0,3}~~~.*?(?:\\n[ ]{0,3}~~~[ \\t]*(?=\\n|\\z)|\\z))"
    "|(?s:(?:(?<=\\n[ \\t\\r]{0,9}\\n)|\\A)(?:[ ]{4}|\\t)[ \\t]*\\S.*?(?=\\n(?![ ]{4}|\\t|[ \\t\\r]*\\n)|\\z))"
    "|(?<![^\\n])[ \\t\\r]*\\n|\\n"
    # a paragraph, line by line (possessive, so that it takes no stack)
    "|[^\\n]++(?:\\n(?![ \\t\\r]*\\n|[ ]{0,3}(?:```|~~~))[^\\n]*+)*+"
)
#: Blocks that hold no prose.
CODE = "^(?:[ ]{0,3}(?:```|~~~)|[ ]{4}|\\t|[ \\t\\r]*\\n?\\z)"
_MARK = "(?:>|[-*+•‣◦]|\\d{1,3}[.)])"
ITEMS = f"(?m)(?=^[ \\t]*(?:>|[-*+•‣◦]|\\d{{1,3}}[.)])[ \\t]+\\S)"
LEAD = f"^(?:[ \\t]*{_MARK}[ \\t]+)+(?=\\S)"

_PAIRS = [p.split(".") for p in PHRASES]
_MONTHS = "(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"

_ANY = f"[.{DOT}]"


def _masks(*rules: tuple[str, str]) -> str:
    """A dot with one of the contexts (before, after) around it. The dot is looked for first, as look-behinds are dear."""
    return "\\.(?:" + "|".join(f"(?<={before}\\.)(?={after})" for before, after in rules) + ")"


#: Dots that end no sentence.
DOTS = _masks(
    # decimals, versions, file names and what else has no space after the mark
    (f"[\\p{{L}}\\p{{M}}\\p{{N}}_)\\]{DOT}]", "[\\p{Ll}\\p{N}_ºª]"),
    ("(?<![\\p{L}\\p{N}.])", "\\p{N}"),
    # abbreviations
    *[(f"{_B}{a}", f"{_W}?{b}{_ANY}") for a, b in [*_PAIRS, ("т", "[дп]")]],
    (f"{_B}(?:{'|'.join(f'{a}{_ANY}{_W}?{b}' for a, b in _PAIRS)})", f"{_W}|$"),
    (f"{_B}{_alt(TITLES)}", f"{_W}*[^\\s]"),
    (f"(?<!\\d{_W}){_B}г", f"{_W}*\\p{{Lu}}"),
    (f"(?<!\\d{_W}){_B}см", f"{_W}*\\S"),
    (f"{_B}{_alt(NUMBERED)}", f"{_W}*(?:\\d|№|[A-Z](?![\\p{{L}}]))"),
    # initials
    (f"(?<!(?:{_alt(LETTERED)}|[Rr]ev{_ANY}){_W})(?<![\\p{{L}}\\p{{M}}\\p{{N}}.{DOT}_])\\p{{Lu}}", f"{_W}?\\p{{Lu}}"),
    (f"\\p{{Lu}}{_ANY}{_W}?\\p{{Lu}}", f"{_W}?\\p{{Lu}}\\p{{Ll}}"),
    (f"{_ANY}\\p{{Lu}}", f"{_W}+\\p{{Ll}}"),
    (f"{_B}\\p{{Ll}}", f"{_W}+\\p{{Ll}}"),
    # German days and ordinals
    (f"{_B}{_alt(ORDINAL)}{_W}\\d{{1,3}}", f"{_W}+\\p{{L}}"),
    ("(?<![\\p{L}\\p{N}.,])\\d{1,2}", f"{_W}+{_MONTHS}\\b"),
    # abbreviations that may end a sentence but don't before what follows here
    (f"{_B}(?:{_alt(MAYBE)}|[pаaPA]{_ANY}[mM]|т{_ANY} ?[дп])", f"{_W}+(?:[\\p{{Ll}}–—-]|[(\\[\"“«„]\\p{{Ll}})"),
    # a time of day that opens a sentence
    (f"{_B}(?:Around|around|At|By|Before|After|Since|From)\\s\\d{{1,2}}(?::\\d\\d)?\\s[ap]{_ANY}m", f"{_W}+\\S"),
)
#: Marks in URLs, masked only where a text has one: a mark with a further URL character behind it.
URLS = [
    (f"((?:https?://|ftp://|\\bwww(?=\\.[a-z]))[!-~{MASKS}&&[^.?!]]*|\\G(?!\\A)[!-~{MASKS}&&[^.?!]]*)\\.(?=[a-z0-9/_%#&=~-])", f"$1{DOT}"),
    (f"((?:https?://|ftp://)[!-~{MASKS}&&[^?!]]*|\\G(?!\\A)[!-~{MASKS}&&[^?!]]*)\\?(?=[A-Za-z0-9/_%#&=~-])", f"$1{MASKS[1]}"),
]
#: A sentence never starts with a dash or a closing or separating mark; after a closing quotation mark or an ellipsis
#: a lower-case letter goes on with the sentence.
_GOES_ON = f"[,;:)\\]»”]|[–—-]{_W}|(?<=[\"”“’'»›…]{_W}{{1,2}}|\\.\\.{_W}{{1,2}})\\p{{Ll}}"
#: Where a sentence may end: single characters are looked at first, the dearer look-behinds only where they fit.
SPLIT = (
    # letters, digits and spaces of Latin script, most of a text, are told by one table look-up
    f"(?<![a-zA-Z0-9 ])(?<=[{_TERM}{_CLOSE}。！？｡{STOPS}{''.join(sorted({w[-1] for w in THAI}))}])(?:"
    # Latin, Cyrillic and other scripts with spaces
    f"(?![{_CLOSE}{_TERM}]|{_W}[»{_TERM}])(?:(?={_W}+(?!{_GOES_ON})\\S)(?<=[{_TERM}](?:{_W}?»)?[{_CLOSE}]{{0,3}})"
    # the space left out
    f"|(?=\\p{{Lu}}[\\p{{Ll}} '’]|[¿¡«„]|\\p{{Lo}})(?<=[\\p{{Ll}}\\p{{Lo}}\\p{{M}}\\p{{N}})\\]»”`%º²][{_TERM}][{_CLOSE}]{{0,2}})"
    "|(?=\\p{Lu}|`)(?<=[\\p{Ll}\\p{M})\\]»”`][!?]))"
    # Chinese and Japanese; a closing quotation mark goes on unless white space follows
    "|(?![。！？｡…）)】」』”’\"»])(?:(?<=[。！？｡][）)】]{0,2})(?=\\s*\\S)|(?=\\s+\\S)(?<=[。！？｡][）)】]{0,2}[」』”’\"]{1,2}[）)]{0,2}))"
    # Devanagari, Arabic and others
    f"|(?![{_CLOSE}{STOPS}!?])(?<=[{STOPS}][{_CLOSE}]{{0,3}})(?=\\s*\\S)"
    # Thai has no mark; a particle before a space closes the sentence
    f"|(?=[ \\t\u00a0\\n]+\\S)(?<={_alt(THAI)}))"
)


def _r(s: str) -> Column:
    return F.lit(s)


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mask_code(item: Column) -> Column:
    """Marks between two backticks of a line masked, one for one."""

    def join(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), F.translate(p, MARKS, MASKS)).otherwise(p)), "`")

    return F.when(F.contains(item, F.lit("`")), _let(F.split(item, "`", -1), join)).otherwise(item)


def mask(item: Column) -> Column:
    """The item, a column, with private-use characters for the marks that end no sentence."""

    def links(t: Column) -> Column:
        linked = t
        for pattern, to in URLS:
            linked = F.regexp_replace(linked, _r(pattern), _r(to))
        return F.when(F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), linked).otherwise(t)

    return F.regexp_replace(_let(mask_code(item), links), _r(DOTS), _r(DOT))


def _offsets(parts: Column, base: Column) -> Column:
    """array<struct<s, at>>: the parts and where they start."""
    starts = F.aggregate(F.transform(parts, lambda p: F.length(p).cast("bigint")), F.array(base.cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.arrays_zip(parts.alias("s"), F.slice(starts, F.lit(1), F.size(parts)).alias("at"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, sentence): a row for each sentence, in code points, without white space around.

    Null and blank texts and texts that are all code have no rows; repeated ids give their rows each. Pieces without
    a letter or digit (rules, stray marks) are no sentences. Texts are whole, however long; nothing is shuffled.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # the parts are a column of their own before their offsets are taken, else they would be split several times
    blocks = d.select("doc_id", F.regexp_extract_all("text", _r(BLOCKS), F.lit(0)).alias("parts")).select("doc_id", F.explode(_offsets(F.col("parts"), F.lit(0))).alias("b")).where(~F.col("b.s").rlike(CODE))
    items = blocks.select("doc_id", F.split(F.col("b.s"), ITEMS, -1).alias("parts"), F.col("b.at").alias("at")).select("doc_id", F.explode(_offsets(F.col("parts"), F.col("at"))).alias("i"))
    items = items.select("doc_id", F.regexp_replace("i.s", _r(LEAD), _r("")).alias("s"), (F.col("i.at") + F.length("i.s")).alias("end")).where("s <> ''")
    items = items.select("doc_id", "s", (F.col("end") - F.length("s")).alias("at"))
    pieces = items.select("doc_id", "s", "at", F.split(mask(F.col("s")), SPLIT, -1).alias("parts")).select("doc_id", "s", "at", F.explode(_offsets(F.col("parts"), F.lit(0))).alias("p"))
    blank = f"^{_W}+"
    lead = F.length("p.s") - F.length(F.regexp_replace("p.s", _r(blank), _r("")))
    core = F.regexp_replace(F.regexp_replace("p.s", _r(blank), _r("")), _r(f"{_W}+$"), _r(""))
    pieces = pieces.select("doc_id", (F.col("at") + F.col("p.at") + lead).alias("start_pos"), F.length(core).alias("n"), F.substring(F.col("s"), (F.col("p.at") + lead + 1).cast("int"), F.length(core)).alias("sentence"))
    return pieces.where((F.col("n") > 0) & F.col("sentence").rlike("[\\p{L}\\p{N}]")).select("doc_id", "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"), "sentence")

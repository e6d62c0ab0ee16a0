"""Values typed by hand mapped to a closed list (problem 2).

Each distinct value is split into tokens, each distinct token is joined to the vocabulary's tokens by edit distance
(through shared deletions, long ones through shared trigrams: equi-joins that lose no pair within the room for slips), and
soft TF-IDF over the corrected tokens ranks the entries. Words run together or torn apart are one token each: a value without
its spaces meets the phrases without theirs through shared bigrams. Entries are meant through their canonical value or
any of their labels, or part of one.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import broadcast_if_small, cut

UNMATCHED = "UNMATCHED"
#: Least score of an entry, and least similarity of a whole value without its spaces where tokens alone don't do.
ACCEPT, ACCEPT_WHOLE = 0.5, 0.72
#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKE = ("АВЕЅІЈКМНОРСТУХавеѕіјкмнорстухΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXABESIJKMHOPCTYXABEZHIKMNOPTYX")


def _folds() -> tuple[str, str]:
    """Accented and compatibility letters and their plain upper-case form, by the Unicode decomposition."""
    a, b = [], []
    for code in [*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)[0].upper() if code > 0x7E else ch.upper()
        if base != ch and len(base) == 1 and base.isascii() and base.isprintable():
            a.append(ch)
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _folds()


def folded(c: Column) -> Column:
    """Upper case without accents, look-alike and full-width letters; ligatures apart. Other scripts stay as they are."""
    c = F.translate(F.upper(c), LOOKALIKE[0] + _FROM, LOOKALIKE[1] + _TO)
    for a, b in (("œ", "OE"), ("Œ", "OE"), ("æ", "AE"), ("Æ", "AE"), ("ß", "SS")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, F.lit("\\p{M}"), F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of letters and digits; letters written apart are joined, and a digit that stands for a letter is read so."""
    t = F.filter(F.split(folded(c), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    apart = (F.size(t) > 1) & F.forall(t, lambda x: F.length(x) == 1)
    t = F.when(apart, F.array(F.array_join(t, ""))).otherwise(t)
    return F.transform(t, lambda x: F.when(x.rlike("[A-Z].*[A-Z]|^[A-Z]{2}") & x.rlike("[0-9]"), F.translate(x, "015", "OIS")).otherwise(x))


def _deletions(c: Column) -> Column:
    """The token and all with one or two letters left out."""

    def one(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    first = one(c)
    second = F.flatten(F.transform(F.filter(first, lambda x: F.length(x) > 2), one))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 1, first).otherwise(F.array().cast("array<string>")), F.when(F.length(c) > 3, second).otherwise(F.array().cast("array<string>"))))


def _grams(df: DataFrame, col: str, q: int, pos: str) -> DataFrame:
    """df with a row for each run of q letters of col, its text `gram` and its place."""
    return df.where(F.length(col) >= q).select("*", F.explode(F.sequence(F.lit(1), F.length(col) - (q - 1))).alias(pos)).withColumn("gram", F.substr(F.col(col), F.col(pos), F.lit(q)))


def alike_pairs(values: DataFrame, phrases: DataFrame) -> DataFrame:
    """(field_name, a, b) of values a and phrases b (field_name and the text without spaces) whose edit distance may be within 1 - ACCEPT_WHOLE of the longer.

    Each of k slips spoils two bigrams at most, so of the phrase's 2 k + 1 rarest bigrams one stands in the value, no more than
    k places off; no pair within the distance is lost.
    """
    slack = 1 - ACCEPT_WHOLE
    k = F.floor(F.length("b") * (slack / ACCEPT_WHOLE) + 1e-9).cast("int")
    grams = cut(_grams(phrases.where(F.length("b") > 3), "b", 2, "pb"))
    rarity = grams.groupBy("field_name", "gram").agg(F.count(F.lit(1)).alias("df"))
    distinct = grams.select("field_name", "b", "gram").distinct().join(rarity, ["field_name", "gram"])
    rare = distinct.groupBy("field_name", "b").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g")).select("field_name", "b", F.explode(F.slice("g", F.lit(1), 2 * k + 1)).alias("g")).select("field_name", "b", "g.gram")
    index = grams.join(rare, ["field_name", "b", "gram"])
    near = (F.length("a") >= F.length("b") * ACCEPT_WHOLE - 1e-9) & (F.length("a") <= F.length("b") / ACCEPT_WHOLE + 1e-9) & (F.abs(F.col("pa") - F.col("pb")) <= k)
    return _grams(values.where(F.length("a") > 1), "a", 2, "pa").join(index, ["field_name", "gram"]).where(near).select("field_name", "a", "b").distinct()


def _weight(token: Column, idf: Column) -> Column:
    """Function words of one or two letters hardly count, digits not at all."""
    return F.when(token.rlike("^[0-9]+$"), 0.0).when(F.length(token) <= 2, 0.05 * idf).otherwise(idf)


def repairs(distinct: DataFrame, vocab: DataFrame) -> DataFrame:
    """(field_name, token, ref, sim): each distinct token with the vocabulary's tokens it may be, from (field_name, token) and (field_name, ref)."""
    key = lambda df, c: df.select("*", F.explode(_deletions(F.col(c))).alias("k"))
    # a token longer than the longest reference token by more than the room for slips is none of them
    longest = (vocab.agg(F.max(F.length("ref"))).first()[0] or 0) + 3
    # up to twelve letters: two slips, found through a string that both become by leaving two letters out
    near = key(distinct.where(F.length("token") <= F.least(F.lit(longest), F.lit(14))), "token").join(key(vocab.where(F.length("ref") <= 14), "ref"), ["field_name", "k"]).select("field_name", "token", "ref")
    # beyond: three slips spoil nine of eleven trigrams at most, so one is left at nearly its place
    ta, tb = _grams(distinct.where(F.length("token").between(10, longest)), "token", 3, "pa"), _grams(vocab.where(F.length("ref") >= 10), "ref", 3, "pb")
    far = ta.join(tb, ["field_name", "gram"]).where((F.abs(F.length("token") - F.length("ref")) <= 3) & (F.abs(F.col("pa") - F.col("pb")) <= 3)).select("field_name", "token", "ref")
    near = near.unionByName(far).distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    d = F.levenshtein("token", "ref").cast("double")
    # two letters that changed places are one slip
    d = F.when((d == 2) & (letters(F.col("token")) == letters(F.col("ref"))), 0.9).otherwise(d)
    n = F.greatest(F.length("token"), F.length("ref"))
    room = F.when(n <= 2, 0.0).when(n <= 5, 1.0).when(n <= 12, 2.0).otherwise(3.0)
    close = near.withColumn("d", d).where(F.col("d") <= room).select("field_name", "token", "ref", (1 - F.col("d") / n).alias("sim"))
    # a shortened word: three letters or more that a reference token starts with
    heads = vocab.where("length(ref) > 4").select("field_name", "ref", F.explode(F.transform(F.sequence(F.lit(3), F.length("ref") - 1), lambda i: F.substring(F.col("ref"), F.lit(1), i))).alias("token"))
    short = distinct.join(heads, ["field_name", "token"]).select("field_name", "token", "ref", (0.7 + 0.25 * F.length("token") / F.length("ref")).alias("sim"))
    return close.unionByName(short).groupBy("field_name", "token", "ref").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, vocabulary: DataFrame, phrase_cols: list[str]) -> DataFrame:
    """(field_name, value, canon_value, score) of every distinct (field_name, value); canon_value UNMATCHED if none is meant.

    vocabulary: field_name, canon_value and further columns with labels (phrase_cols names all that count). A field
    without entries gives UNMATCHED. Ties go to the entry with the more alike whole, then to the first by name.
    """
    v = cut(values.select("field_name", "value").distinct().withColumn("tok", tokens(F.col("value"))))
    # what is used several times is stored: the list's side and the repairs are small, and the plans stay short
    phrases = cut(vocabulary.select("field_name", "canon_value", F.explode(F.array_distinct(F.array(*phrase_cols))).alias("phrase")).where("phrase IS NOT NULL").withColumn("ptok", tokens(F.col("phrase"))))
    ptok = phrases.select("field_name", "canon_value", "phrase", F.explode(F.array_distinct("ptok")).alias("ref"))
    n = phrases.groupBy("field_name").agg(F.countDistinct("canon_value").alias("n"))
    idf = cut(ptok.groupBy("field_name", "ref").agg(F.countDistinct("canon_value").alias("df")).join(n, "field_name").select("field_name", "ref", _weight(F.col("ref"), F.log(1 + F.col("n") / F.col("df"))).alias("w"), F.log(1 + F.col("n")).alias("w_max")))
    vt = v.select("field_name", "value", F.explode(F.array_distinct("tok")).alias("token"))
    rep = cut(repairs(vt.select("field_name", "token").distinct(), idf.select("field_name", "ref")).join(idf, ["field_name", "ref"]))
    # what a value weighs: its tokens' likeliest reading, or half of a rare word's weight if there is none
    best = rep.groupBy("field_name", "token").agg(F.max_by("w", "sim").alias("w"))
    top = idf.groupBy("field_name").agg(F.max("w_max").alias("w_max"))
    mass = vt.join(best, ["field_name", "token"], "left").join(top, "field_name").groupBy("field_name", "value").agg(F.sum(F.pow(F.coalesce("w", 0.35 * _weight(F.col("token"), F.col("w_max"))), F.lit(2))).alias("mass"))
    pmass = ptok.join(idf, ["field_name", "ref"]).groupBy("field_name", "canon_value", "phrase").agg(F.sum(F.pow("w", F.lit(2))).alias("pmass"))
    hit = vt.join(rep, ["field_name", "token"]).join(ptok, ["field_name", "ref"]).groupBy("field_name", "value", "canon_value", "phrase", "ref").agg(F.max(F.struct("sim", "w")).alias("m"))
    soft = hit.groupBy("field_name", "value", "canon_value", "phrase").agg(F.sum(F.pow("m.w", F.lit(2)) * F.col("m.sim")).alias("dot"), F.max(F.when(F.length("ref") > 2, F.col("m.sim"))).alias("lead"))
    soft = soft.join(mass, ["field_name", "value"]).join(pmass, ["field_name", "canon_value", "phrase"])
    # cosine against what the value has, and half as much against the whole phrase: a part of it may be meant
    soft = cut(soft.select("field_name", "value", "canon_value", "phrase", "lead", (F.col("dot") / F.greatest("mass", F.lit(1e-9))).alias("of_value"), (F.col("dot") / F.sqrt(F.col("mass") * F.col("pmass") + 1e-12)).alias("cosine")))
    # words run together or torn apart: the value and the phrase as one token each
    va = v.select("field_name", "value", F.array_join("tok", "").alias("a"))
    pb = phrases.select("field_name", "canon_value", "phrase", F.array_join("ptok", "").alias("b"))
    joined = cut(alike_pairs(va.select("field_name", "a").distinct(), pb.select("field_name", "b").distinct())).join(va, ["field_name", "a"]).join(pb, ["field_name", "b"]).select("field_name", "value", "canon_value", "phrase")
    pairs = joined.unionByName(soft.select("field_name", "value", "canon_value", "phrase")).distinct()
    whole = pairs.join(va, ["field_name", "value"]).join(pb, ["field_name", "canon_value", "phrase"])
    whole = whole.select("field_name", "value", "canon_value", "phrase", F.when(F.length("a") > 2 * F.length("b") + 8, 0.0).otherwise(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1))).alias("alike"), (F.length("b") > 3).alias("long"))
    ranked = whole.join(soft, ["field_name", "value", "canon_value", "phrase"], "left")
    score = F.greatest(F.when(F.col("lead") >= 0.6, 0.6 * F.least(F.col("of_value"), F.lit(1.0)) + 0.4 * F.least(F.col("cosine"), F.lit(1.0))), F.when(F.col("long") & (F.col("alike") >= ACCEPT_WHOLE), F.col("alike")), F.lit(0.0))
    ranked = ranked.withColumn("score", score).groupBy("field_name", "value", "canon_value").agg(F.max("score").alias("score"), F.max("alike").alias("alike"))
    first = ranked.groupBy("field_name", "value").agg(F.max_by(F.struct("canon_value", "score"), F.struct(F.round("score", 9), F.round("alike", 9), F.lit(0) - F.hash("canon_value"), "canon_value")).alias("b"))
    return v.select("field_name", "value").join(first, ["field_name", "value"], "left").select("field_name", "value", F.when(F.col("b.score") >= ACCEPT, F.col("b.canon_value")).otherwise(UNMATCHED).alias("canon_value"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def map_rows(rows: DataFrame, vocabulary: DataFrame, phrase_cols: list[str]) -> DataFrame:
    """(field_name, id, value, canon_value) of the rows (field_name, id, value) whose value is typed otherwise than the list has it.

    Null, empty and blank values and values that are letter for letter in the list are left out. A value that a third
    of all rows share is one distinct value; the rows themselves are only shuffled where the mapping is large.
    """
    exact = vocabulary.select("field_name", F.col("canon_value").alias("value")).distinct()
    typed = rows.where("value IS NOT NULL AND trim(value) <> ''").join(broadcast_if_small(exact), ["field_name", "value"], "left_anti")
    mapping = cut(map_values(typed, vocabulary, phrase_cols).select("field_name", "value", "canon_value"))
    return typed.join(broadcast_if_small(mapping), ["field_name", "value"]).select("field_name", "id", "value", "canon_value")

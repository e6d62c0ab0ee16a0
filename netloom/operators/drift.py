"""Schemas that drift between the files of a series (problem 5).

The schema of a file is a tree: fields, below them the fields of nested objects. Consecutive files of a series are
compared by a tree edit distance whose cheapest script says which fields were added, removed, renamed, moved or
changed in type. A rename costs little only where the values bear it out: for the records in both files, the new
field holds what the gone one held. The scripts then become projections that bring every file to one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import broadcast_if_small, cut, release

#: Between the names on the path to a nested field.
SEP = "\u001f"
#: Costs of a script's steps: a rename that the values bear out or refute, an addition or removal, a change of type.
RENAME, REFUTED, INDEL, RETYPE = 0.5, 10.0, 1.0, 0.75
#: Share of the records in both files in which the values must agree for a rename.
AGREE = 0.8


def _no_constant(token: str) -> float:
    raise ValueError(token)


def parse_line(text: str | None) -> dict | None:
    """The object a line holds, or None if it isn't one whole JSON object."""
    try:
        value = json.loads(text, parse_constant=_no_constant) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of the object's fields, nested ones too; arrays count as values."""
    for k, v in value.items():
        yield prefix + k, v
        if isinstance(v, dict):
            yield from leaves(v, prefix + k + SEP)


class _Number(float):
    """A number that keeps how it was written."""

    raw = ""


def _as_written(text: str) -> _Number:
    n = _Number(text)
    n.raw = text
    return n


def field_texts(text: str | None) -> dict[str, str | None] | None:
    """The values of a line's fields as texts, nested ones under their path, or None if it isn't one whole JSON object."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_as_written) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    out: dict[str, str | None] = {}
    for path, v in leaves(value):
        if isinstance(v, dict) and v:
            continue  # its fields stand for it
        out[path] = v if v is None or isinstance(v, str) else v.raw if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)
    return out


_KINDS = {bool: "bool", int: "int", float: "double", str: "string", dict: "object", list: "array"}


def kind_of(kinds: set[str]) -> str:
    """One type for a file's non-null values: int and double give double, other mixtures string, no value `null`."""
    kinds = kinds - {"null"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "null" if not kinds else "double" if kinds == {"int", "double"} else "string"


def field_stats(raw: DataFrame, key_pattern: str) -> DataFrame:
    """(series, file_id, delivered_at, path, kinds, key_hits): a row for each field of each file.

    `kinds` are the types seen, `key_hits` the values that match key_pattern. Lines are reduced in their own
    partition before the shuffle.
    """
    is_key = re.compile(key_pattern).fullmatch

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse_line(text)
                if value is None:
                    continue
                for path, v in leaves(value):
                    s = seen.get((file, path))
                    if s is None:
                        s = seen[(file, path)] = [set(), 0]
                    s[0].add(_KINDS.get(type(v), "null"))
                    if type(v) is str and is_key(v):
                        s[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.string()), pa.array([sorted(v[0]) for v in seen.values()], pa.list_(pa.string())), pa.array([v[1] for v in seen.values()], pa.int64())], names=["file_id", "path", "kinds", "key_hits"]
            )

    rows = raw.select("file_id", "record").mapInArrow(count, "file_id long, path string, kinds array<string>, key_hits long")
    return rows.groupBy("file_id", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.sum("key_hits").alias("key_hits"))


def file_pairs(raw: DataFrame) -> DataFrame:
    """(file_id, prev_id) of every file and the one delivered before it in its series (NULL for the first).

    Files delivered at the same time follow their file_id. Only file rows are windowed, never lines.
    """
    files = raw.groupBy("series", "file_id").agg(F.min("delivered_at").alias("delivered_at"))
    w = Window.partitionBy("series").orderBy("delivered_at", "file_id")
    return files.select("series", "file_id", "delivered_at", F.lag("file_id").over(w).alias("prev_id"), F.row_number().over(w).alias("seq"))


def evidence(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair_id, gone, new, both, same): over the records in both files, how often a gone and a new field agree.

    wanted: (file_id, pair_id, role, paths, key_path), role `p` for the earlier file of the pair and `c` for the later.
    Records are matched by the value at key_path; repeated lines of a record count once, with their least value.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            last, parsed = None, None
            for text, pair, role, paths, key_path in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if text != last:
                    value = parse_line(text)
                    last, parsed = text, None if value is None else dict(leaves(value))
                if parsed is None or not isinstance(key := parsed.get(key_path), str):
                    continue
                box = xxhash.xxh64_intdigest(key.strip().upper()) - (1 << 63)
                for path in paths:
                    v = parsed.get(path)
                    if v is not None:
                        out.append((pair, role, box, path, xxhash.xxh64_intdigest(json.dumps([type(v).__name__, v], sort_keys=True)) - (1 << 63)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], names=["pair_id", "role", "box", "path", "h"])

    rows = raw.select("file_id", "record").join(wanted, "file_id").select("record", "pair_id", "role", "paths", "key_path")
    cells = rows.mapInArrow(emit, "pair_id long, role string, box long, path string, h long").groupBy("pair_id", "role", "box", "path").agg(F.min("h").alias("h"))
    per_box = cells.groupBy("pair_id", "box").agg(F.collect_list(F.when(F.col("role") == "p", F.struct("path", "h"))).alias("p"), F.collect_list(F.when(F.col("role") == "c", F.struct("path", "h"))).alias("c"))
    pairs = per_box.select("pair_id", F.explode("p").alias("p"), "c").select("pair_id", "p", F.explode("c").alias("c"))
    return pairs.groupBy("pair_id", F.col("p.path").alias("gone"), F.col("c.path").alias("new")).agg(F.count(F.lit(1)).alias("both"), F.sum((F.col("p.h") == F.col("c.h")).cast("int")).alias("same"))


def assign(cost: list[list[float]]) -> list[int]:
    """Cheapest assignment of the rows to columns (as many as rows or more): a column for each row, by potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def edit_script(old: dict[str, str], new: dict[str, str], agreement: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, str]]:
    """(kind, field, previous): the cheapest script from one schema tree to the other.

    old and new: path -> type. Children are matched level by level at least cost (the edit distance of unordered
    trees constrained to keep ancestry): equal names, or renames borne out by `agreement` (records in both, records
    that agree). A removed and an added field of one name, type and agreeing values under different parents move.
    """

    def children(tree: dict[str, str], at: str) -> dict[str, str]:
        pre = at + SEP if at else ""
        return {p: k for p, k in tree.items() if p.startswith(pre) and SEP not in p[len(pre) :]}

    def below(tree: dict[str, str], at: str) -> list[str]:
        return [p for p in tree if p == at or p.startswith(at + SEP)]

    def agrees(a: str, b: str) -> bool:
        both, same = agreement.get((a, b), (0, 0))
        return both > 0 and same >= AGREE * both

    def step(a: str, b: str) -> tuple[float, list]:
        """Cost and script of making the node a into b, with all below."""
        script, cost = [], 0.0
        if a.split(SEP)[-1] != b.split(SEP)[-1]:
            fits = old[a] == new[b] and (agrees(a, b) or old[a] == "object")
            if not fits:
                return REFUTED, []
            cost += RENAME - 0.1 * agreement.get((a, b), (0, 0))[1] / max(1, agreement.get((a, b), (1, 0))[0])
            script.append(("renamed", b, a))
        elif old[a] != new[b] and "null" not in (old[a], new[b]):
            cost += RETYPE
            script.append(("type", b, ""))
        inner, more = level(a, b)
        return cost + inner, script + more

    def level(a: str, b: str) -> tuple[float, list]:
        left, right = children(old, a), children(new, b)
        rest_l, rest_r, script, cost = [], [], [], 0.0
        names = {p.split(SEP)[-1]: p for p in right}
        for p in sorted(left):
            if (q := names.pop(p.split(SEP)[-1], None)) is None:
                rest_l.append(p)
            else:
                c, s = step(p, q)
                cost, script = cost + c, script + s
        rest_r = sorted(names.values())
        if rest_l or rest_r:
            n, m = len(rest_l), len(rest_r)
            steps = {(i, j): step(p, q) for i, p in enumerate(rest_l) for j, q in enumerate(rest_r)}
            gone = [INDEL * len(below(old, p)) for p in rest_l]
            come = [INDEL * len(below(new, q)) for q in rest_r]
            matrix = [[steps[i, j][0] if j < m else gone[i] if j - m == i else 1e6 for j in range(m + n)] for i in range(n)]
            matrix += [[come[j] if j == k else 1e6 if j < m else 0.0 for j in range(m + n)] for k in range(m)]
            for i, j in enumerate(assign(matrix)):
                cost += matrix[i][j]
                if i < n and j < m and steps[i, j][0] < REFUTED:
                    script += steps[i, j][1]
                elif i < n:
                    script += [("removed", p, "") for p in below(old, rest_l[i])]
                    if j < m:
                        script += [("added", p, "") for p in below(new, rest_r[j])]
                elif j < m:
                    script += [("added", p, "") for p in below(new, rest_r[j])]
        return cost, script

    script = level("", "")[1]
    added = {p for k, p, _ in script if k == "added"}
    for kind, p, _ in list(script):
        if kind == "removed":
            for q in sorted(added):
                if q.split(SEP)[-1] == p.split(SEP)[-1] and old[p] == new[q] and agrees(p, q):
                    script = [s for s in script if s not in (("removed", p, ""), ("added", q, ""))] + [("moved", q, p)]
                    added.discard(q)
                    break
    return sorted(script)


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for pair, was, now, ev in zip(*(batch.column(i).to_pylist() for i in range(4))):
            old, new = ({f["path"]: kind_of(set(f["kinds"])) for f in x} for x in (was, now))
            for kind, path, prev in edit_script(old, new, {(e["gone"], e["new"]): (e["both"], e["same"]) for e in ev or ()}):
                out.append((pair, path, kind, prev))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["file_id", "field_path", "drift_kind", "prev_path"])


def drift_events(raw: DataFrame, key_pattern: str) -> DataFrame:
    """(file_id, field_path, drift_kind, prev_path) of every file but the first of its series.

    raw: series, file_id, delivered_at, record; other columns are ignored. Null records, cut-off lines and lines that
    aren't JSON objects count for nothing; a file without any whole line has no fields. key_pattern tells the values
    that identify a record: a file's key is the field with most of them (ties: the first name), and a file without
    such values has no evidence for renames. An empty table has no events.
    """
    pairs = file_pairs(raw)
    stats = field_stats(raw, key_pattern)
    best = F.max_by("path", F.struct("key_hits", F.lit(0) - F.length("path"), "path"))
    schemas = stats.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("path", "kinds"))).alias("fields"), best.alias("key_path"))
    # a row a file: some 13 names and types
    both = pairs.where("prev_id IS NOT NULL").join(schemas.select("file_id", F.col("fields").alias("now"), F.col("key_path").alias("now_key")), "file_id", "left")
    both = both.join(schemas.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("was"), F.col("key_path").alias("was_key")), "prev_id", "left")
    none = F.array().cast("array<struct<path:string,kinds:array<string>>>")
    both = cut(both.select("file_id", "prev_id", F.coalesce("was", none).alias("was"), F.coalesce("now", none).alias("now"), "was_key", "now_key").where("was IS DISTINCT FROM now"))
    paths = lambda c: F.transform(c, lambda f: f["path"])
    differ = both.select("file_id", "prev_id", "was_key", "now_key", F.array_except(paths("was"), paths("now")).alias("gone"), F.array_except(paths("now"), paths("was")).alias("new")).where("size(gone) > 0 AND size(new) > 0")
    wanted = differ.select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("pair_id"), F.lit("p").alias("role"), F.col("gone").alias("paths"), F.col("was_key").alias("key_path")).unionByName(
        differ.select("file_id", F.col("file_id").alias("pair_id"), F.lit("c").alias("role"), F.col("new").alias("paths"), F.col("now_key").alias("key_path"))
    )
    agreed = evidence(raw, broadcast_if_small(wanted)).groupBy(F.col("pair_id").alias("file_id")).agg(F.collect_list(F.struct("gone", "new", "both", "same")).alias("ev"))
    return both.join(agreed, "file_id", "left").select("file_id", "was", "now", "ev").mapInArrow(_scripts, "file_id long, field_path string, drift_kind string, prev_path string")


def lineages(raw: DataFrame, events: DataFrame, standard: list[str]) -> DataFrame:
    """(file_id, path, canon, rank): what every field of every file is called in the one table.

    Fields of a series that follow each other by renames are one lineage. It takes the standard name it ever had
    that stands first in the list; one that never had any takes the standard name its own name mostly leads to in other series, or else its first
    name. Lineages are followed to their first segment by pointer jumping, so long chains need few rounds. `rank` tells
    how good a claim it is where several fields of a file lead to one name: 0 for the field's own name, 1 for the
    standard name its lineage had, 2 for a vote, 3 for a first name.
    """
    files = cut(file_pairs(raw))
    stats = cut(field_stats(raw, "").select("file_id", "path").join(files.select("file_id", "series", "seq"), "file_id"))
    ev = cut(events.join(files.select("file_id", "series", "seq"), "file_id"))
    first = stats.where("seq = 1").select("series", "path", "seq", F.lit(None).cast("string").alias("prev"))
    later = ev.where("drift_kind IN ('added', 'renamed', 'moved')").select("series", F.col("field_path").alias("path"), "seq", F.when(F.col("drift_kind") != "added", F.col("prev_path")).alias("prev"))
    starts = cut(first.unionByName(later).dropDuplicates(["series", "path", "seq"]).withColumn("seg", F.xxhash64("series", "path", "seq")))
    old = starts.select("series", F.col("path").alias("prev"), F.col("seq").alias("oseq"), F.col("seg").alias("oseg"))
    up = starts.where("prev IS NOT NULL").join(old, ["series", "prev"]).where("oseq < seq").groupBy("seg").agg(F.max_by("oseg", "oseq").alias("up"))
    root = cut(starts.select("seg").join(up, "seg", "left").select("seg", F.coalesce("up", "seg").alias("root")))
    hop = None
    while True:
        old, hop = hop, cut(root.join(root.select(F.col("seg").alias("root"), F.col("root").alias("far")), "root").select("seg", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        if old is not None:
            release(old)
        root = hop.select("seg", "root")
        if hop.where("moved").isEmpty():
            break
    named = cut(starts.join(root, "seg"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in standard]), F.col("path")), F.lit(0))
    std = F.min_by(F.when(rank > 0, F.col("path")), F.when(rank > 0, rank))
    per = cut(named.groupBy("root").agg(std.alias("std"), F.min_by("path", F.struct("seq", "path")).alias("first_name")))
    votes = named.join(per.where("std IS NOT NULL"), "root").where(rank == 0).groupBy("path", "std").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max_by("std", F.struct("n", "std")).alias("vote"))
    by_vote = named.join(votes, "path").groupBy("root").agg(F.min_by("vote", F.struct("seq", "path")).alias("vote"))
    canon = per.join(by_vote, "root", "left").select("root", F.coalesce("std", "vote", "first_name").alias("canon"), F.when(F.col("std").isNotNull(), 1).when(F.col("vote").isNotNull(), 2).otherwise(3).alias("rank"))
    # each file's field belongs to the latest segment of its name that had begun
    marks = stats.select("series", "path", "seq", "file_id", F.lit(None).cast("long").alias("root")).unionByName(named.select("series", "path", "seq", F.lit(None).cast("long").alias("file_id"), "root"))
    w = Window.partitionBy("series", "path").orderBy("seq", F.col("file_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("root", F.last("root", ignorenulls=True).over(w)).where("file_id IS NOT NULL")
    named_as = held.join(canon, "root", "left").withColumn("canon", F.coalesce("canon", "path"))
    return named_as.select("file_id", "path", "canon", F.when(F.col("path") == F.col("canon"), 0).otherwise(F.col("rank")).alias("rank"))


def places(fields: list[tuple[str, str, int]], columns: set[str]) -> tuple[dict[str, str], dict[str, str]]:
    """(column -> path, path -> key in `more`) of a file's (path, canon, rank): each place to one field, a place to each field.

    The best rank has the name, then the first by name. A field that loses goes to `more` under its own name, before
    any other that leads there; own names differ, so no two lose for good.
    """
    own: set[str] = set()
    while True:
        claims: dict[tuple[bool, str], list[tuple[int, str]]] = {}
        for path, canon, rank in fields:
            at = (False, path) if path in own else (canon in columns, canon)
            claims.setdefault(at, []).append((-1 if path in own else rank, path))
        lost = {path for c in claims.values() for _, path in sorted(c)[1:]}
        if not lost:
            return {n: c[0][1] for (is_column, n), c in claims.items() if is_column}, {c[0][1]: n for (is_column, n), c in claims.items() if not is_column}
        own |= lost


def consistent_table(raw: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """raw_id, series, file_id, line_no, the columns (canonical name -> type) and `more`, a map of what else a line holds.

    Lines that aren't whole objects are left out; of a key that a line repeats the last value counts, as for the events. A
    nested field stands under its path, an array as its text. Values that don't fit a column's type are NULL there
    (decimal commas are read). Of several fields of one file that lead to one name the best rank has it (see lineages), the others stand
    in `more` under their own names, also where such a name is a column's.
    """
    wanted = set(columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [places([(f["path"], f["canon"], f["rank"]) for f in fields], wanted) for fields in batch.column(1).to_pylist()]
            maps = [pa.array([list(g[k].items()) for g in got], pa.map_(pa.string(), pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *maps], names=["file_id", "__at", "__else"])

    per_file = names.groupBy("file_id").agg(F.collect_set(F.struct("path", "canon", "rank")).alias("fields"))
    per_file = cut(per_file.mapInArrow(place, "file_id long, __at map<string,string>, __else map<string,string>"))
    rows = raw.select("raw_id", "series", "file_id", "line_no", "record").join(broadcast_if_small(per_file), "file_id", "left")
    heads = [f for f in rows.schema.fields if f.name in ("raw_id", "series", "file_id", "line_no", "__at", "__else")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [field_texts(t) for t in batch.column(0).to_pylist()]
            whole = pa.array([g is not None for g in got])
            kept = pa.array([list(g.items()) for g in got if g is not None], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).filter(whole) for i in range(len(heads))), kept], names=[*(f.name for f in heads), "__m"])

    m = rows.select("record", *[f.name for f in heads]).mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in heads), "__m map<string,string>"]))
    rest = F.filter(F.transform(F.map_entries("__m"), lambda e: F.struct(F.try_element_at(F.col("__else"), e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())

    def typed(name: str, kind: str):
        v = F.try_element_at("__m", F.try_element_at("__at", F.lit(name)))
        return (v if kind == "string" else F.replace(F.trim(v), F.lit(","), F.lit(".")).try_cast("double").try_cast(kind) if kind != "boolean" else v.try_cast(kind)).alias(name.lower())

    return m.select("raw_id", "series", "file_id", "line_no", *[typed(n, k) for n, k in columns.items()], F.map_from_entries(rest).alias("more"))

"""Schemas that drift between files of one kind: tagged-union inference, changes, one consistent table.

Every body is reduced, in one pass, to its layout. All layouts are fused into one union: each path keeps
every type seen under it as an alternative of its own, with a tag. A layout is then the set of tags it
takes, and files carry a digest of it. What differs between a file and the one before it from the same
source are the alternatives of the union that appear and vanish: a field that had none is added, one that has
none any more is removed, one that goes to another branch is retyped. ``changes`` reports these, ``inferred`` the
union itself, and ``consistent`` reads everything into one table with typed branches and canonical conversions.

Layouts are few against files, so all comparing runs over distinct pairs of layouts; only digests, times
and ids are kept per file.

Paths are dotted. An object of which all values are objects is a map: its keys are data, written ``*``.

Defined cases. A body that is null, empty, unreadable or no JSON object has no layout and is passed
over, and so is one nested more deeply than the reader can follow. NaN and Infinity are not JSON; a number
too large for a double (``1e999``) is one. A null keeps the type seen last (of the same source and path);
before any type was seen it agrees with all. Arrays are not looked into. The entries of a map that
differ in a field's type give the union of the types, written with ``|``. Nothing is compared below a
path that changed, nor below an object that is null or empty on either side. Files received at the
same instant are ordered by id; files without a time come first; a null source is a source of its own.
Equal files change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut
from .components import connected_components
from .sequences import carry_last

#: Two names that stand side by side in more than this share of the rarer one's files are two fields.
TOGETHER = 0.02
#: The least overlap of two fields' distributions over classes of content that may be one field.
ALIKE = 0.25
#: Entries that a worker remembers having handed on, or counts before it hands them on.
HELD = 200_000

#: Kinds of rows: a file with its layout's digest; a layout's tags; an alternative of the union; counts of content.
FILE, LAYOUT, ALTERNATIVE, CONTENT = range(4)
_REDUCED = "kind int, id long, source string, received timestamp, raw binary, tags array<long>, heads array<long>, tag long, head long, path string, parent string, type string, class string, n long"

#: Classes of the content of strings: the first that fits.
_CLASSES = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in [
            ("stamp", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*"),
            ("date", r"\d{4}[-/]?\d\d[-/]?\d\d"),
            ("offset", r"[+-]\d\d:?\d\d"),
            ("version", r"v?\d+(?:\.\d+)+\w*"),
            ("digits", r"[+-]?\d+"),
            ("hex", r"(?=[0-9a-f]*\d)[0-9a-f]{8,}(?:\+\w+)?"),
            ("name_number", r"[A-Za-z]+(?:[-_ .][A-Za-z]+)*[-_ .]?\d+"),
            ("name", r"[A-Za-z]+(?:[-_ .][A-Za-z]+)*"),
        ]
    )
)


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(v)]


def _is_map(v: dict) -> bool:
    return bool(v) and all(isinstance(x, dict) for x in v.values())


def _class(v) -> str:
    """The class of a value's content: coarse, from a small set, whatever its type."""
    if isinstance(v, str):
        s = v.strip()
        found = _CLASSES.fullmatch(s) if s else None
        return found.lastgroup if found else "text" if s else "blank"
    if isinstance(v, dict):
        return "map" if _is_map(v) else "record:" + ",".join(sorted({_kind(x) for x in v.values()}))
    if isinstance(v, list):
        return "array:" + ",".join(sorted({_class(x) for x in v}))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        # whole digits; beyond 64 bits, infinite ones included, they are all alike
        return f"digits{len(str(abs(int(v))))}" if abs(v) < 2**63 else "digits"
    return _kind(v)


def _no_constant(s: str):
    raise ValueError(s)


def read_object(body: str | None) -> dict | None:
    """The JSON object in a body, or None."""
    sys.set_int_max_str_digits(0)  # a number of any length is one
    try:
        o = json.loads(body, parse_constant=_no_constant) if body else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _clean(s: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _walk(o: dict, at: str, fields: dict, content: dict) -> None:
    for k, v in o.items():
        path = f"{at}.{_clean(k)}" if at else _clean(k)
        kind = _kind(v)
        fields.setdefault((path, at), set()).add(kind)
        if v is not None:
            c = path, _class(v)
            content[c] = content.get(c, 0) + 1
        if kind == "object":
            if _is_map(v):
                for x in v.values():
                    _walk(x, f"{path}.*", fields, content)
            else:
                _walk(v, path, fields, content)


def layout_of(body: str | None) -> tuple[list[tuple[str, str, str]], dict[tuple[str, str], int]] | None:
    """The fields (path, parent, type) of a body, and how often each (path, class of content) stands in it."""
    o = read_object(body)
    if o is None:
        return None
    fields: dict = {}
    content: dict = {}
    try:
        _walk(o, "", fields, content)
    except RecursionError:
        return None
    return [(p, at, "|".join(sorted(kinds - {"null"})) or "null") for (p, at), kinds in fields.items()], content


def _tag(*of: str) -> int:
    return int.from_bytes(blake2b("\0".join(of).encode(), digest_size=8).digest(), "little", signed=True)


def layouts(files: DataFrame, id: str, source: str, received: str, body: str) -> DataFrame:
    """One pass over the bodies: a row per readable file, and what a worker saw of layouts, alternatives and content."""
    schema = to_arrow_schema(StructType.fromDDL(_REDUCED))

    def reduce(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(n: int, kind: int, /, **columns):
            columns["kind"] = [kind] * n
            as_array = lambda f: pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type)
            return pa.RecordBatch.from_arrays([as_array(f) for f in schema], schema=schema)

        alternatives: dict = {}  # (path, parent, type) -> (tag, head)
        handed_on: set = set()
        content: dict = {}

        def counts():
            yield rows(len(content), CONTENT, path=[k[0] for k in content], **{"class": [k[1] for k in content]}, n=list(content.values()))
            content.clear()

        for batch in batches:
            keep, raws, fresh, told = [], [], {}, []
            for b in batch.column("body"):
                found = layout_of(b.as_py())
                keep.append(found is not None)
                if found is None:
                    continue
                tags, heads = [], set()
                for f in found[0]:
                    t = alternatives.get(f)
                    if t is None:
                        t = alternatives[f] = _tag("alternative", f[0], f[2]), _tag("parent", f[1])
                        told.append((*t, *f))
                    tags.append(t[0])
                    heads.add(t[1])
                tags.sort()
                raw = blake2b(b"".join(t.to_bytes(8, "little", signed=True) for t in tags), digest_size=16).digest()
                raws.append(raw)
                if raw not in handed_on:
                    handed_on.add(raw)
                    fresh[raw] = tags, sorted(heads)
                for c, n in found[1].items():
                    content[c] = content.get(c, 0) + n
            mask = pa.array(keep, pa.bool_())
            yield rows(len(raws), FILE, raw=raws, **{c: batch.column(c).filter(mask) for c in ("id", "source", "received")})
            yield rows(len(fresh), LAYOUT, raw=list(fresh), tags=[x[0] for x in fresh.values()], heads=[x[1] for x in fresh.values()])
            if told:
                t = list(zip(*told))
                yield rows(len(told), ALTERNATIVE, tag=t[0], head=t[1], path=t[2], parent=t[3], type=t[4])
            if len(content) >= HELD:
                yield from counts()
            if len(handed_on) >= HELD:
                handed_on.clear()
            if len(alternatives) >= HELD:
                alternatives.clear()
        yield from counts()

    narrow = files.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(received).cast("timestamp").alias("received"), F.col(body).cast("string").alias("body"))
    return narrow.mapInArrow(reduce, _REDUCED)


def reduced(files: DataFrame, id: str, source: str, received: str, body: str) -> DataFrame:
    """The layouts, written to the shared folder: every later step reads these narrow rows, not the bodies."""
    return cut(layouts(files, id, source, received, body))


def _files(reduced_files: DataFrame) -> DataFrame:
    """(id, source, src, received, chunk, raw): src is never null."""
    f = reduced_files.filter(F.col("kind") == FILE)
    first = F.timestamp_seconds(F.lit(-62_135_596_800))
    f = f.select("id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), F.coalesce("received", first).alias("received"), "raw")
    return f.withColumn("chunk", F.floor(F.unix_seconds("received") / 86_400))


def _layouts(reduced_files: DataFrame) -> DataFrame:
    """(raw, tags, heads): the alternatives each layout takes, and the parents that have fields in it."""
    return reduced_files.filter(F.col("kind") == LAYOUT).groupBy("raw").agg(F.first("tags").alias("tags"), F.first("heads").alias("heads"))


def fused(reduced_files: DataFrame) -> DataFrame:
    """The union of all layouts: (tag, head, path, parent, type), one row per alternative."""
    one = F.struct("head", "path", "parent", "type")
    u = reduced_files.filter(F.col("kind") == ALTERNATIVE).groupBy("tag").agg(F.min(one).alias("one"), F.max(one).alias("other"))
    same = F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.raise_error(F.lit("two alternatives have one tag")).cast("struct<head:long,path:string,parent:string,type:string>"))
    return u.select("tag", same.alias("a")).select("tag", "a.*")


_FIELD = "struct<path:string,parent:string,type:string>"
_NAMES = "array<struct<path:string,new_path:string>>"


def _appearing(steps: DataFrame, reduced_files: DataFrame, union: DataFrame) -> DataFrame:
    """What differs between two layouts, in alternatives of the union: (previous, raw, gone, new, retyped, woke, left).

    ``gone`` and ``new`` are fields, ``retyped`` paths that went from one typed branch to another, ``woke`` fields that were
    null before, ``left`` typed fields that are null or gone now.
    """
    known = _layouts(reduced_files)
    side = lambda n, k: known.select(F.col("raw").alias(n), F.col("tags").alias(f"tags_{k}"), F.col("heads").alias(f"heads_{k}"))
    pairs = steps.select("previous", "raw").distinct().join(side("previous", "a"), "previous").join(side("raw", "b"), "raw")
    of = lambda x, y, appears: F.transform(F.array_except(f"tags_{x}", f"tags_{y}"), lambda t: F.struct(t.alias("tag"), F.lit(appears).alias("appears")))
    moved = pairs.select("previous", "raw", F.array_intersect("heads_a", "heads_b").alias("heads"), F.inline(F.concat(of("a", "b", False), of("b", "a", True))))
    told = moved.join(union, "tag").select("previous", "raw", "appears", "path", "parent", "type", F.array_contains("heads", F.col("head")).alias("comparable"))
    each = F.collect_list(F.when(F.col("comparable") & F.col("appears"), F.struct("path", "parent", "type")))
    lost = F.collect_list(F.when(~F.col("appears"), F.struct("path", "parent", "type", "comparable")))
    by = told.groupBy("previous", "raw").agg(each.alias("b"), lost.alias("a"))
    by = by.withColumn("types_a", F.map_from_entries(F.transform("a", lambda f: F.struct(f["path"], f["type"])))).withColumn("types_b", F.map_from_entries(F.transform("b", lambda f: F.struct(f["path"], f["type"]))))
    was = lambda f: F.element_at("types_a", f["path"])
    now = lambda f: F.coalesce(F.element_at("types_b", f["path"]), F.lit("null"))
    paths = lambda x: F.transform(x, lambda f: f["path"])
    return by.select(
        "previous", "raw",
        F.transform(F.filter("a", lambda f: f["comparable"] & ~F.map_contains_key("types_b", f["path"])), lambda f: f.dropFields("comparable")).alias("gone"),
        F.filter("b", lambda f: ~F.map_contains_key("types_a", f["path"])).alias("new"),
        paths(F.filter("b", lambda f: (f["type"] != "null") & (was(f) != "null") & (was(f) != f["type"]))).alias("retyped"),
        F.filter("b", lambda f: (f["type"] != "null") & (was(f) == "null")).alias("woke"),
        F.filter("a", lambda f: (f["type"] != "null") & (now(f) == "null")).alias("left"),
    )


def _renames(moves: DataFrame, reduced_files: DataFrame, union: DataFrame) -> DataFrame:
    """(previous, raw, renamed): of the fields gone and new under one parent, those whose content goes on.

    A pair is a candidate if the types agree. It is one field only if the two names practically never
    stand side by side in one file of the corpus and their contents are alike: the overlap of the two
    distributions over classes of content. Each name takes its most alike partner, and only mutual
    choices count.
    """
    g = moves.filter("size(gone) > 0 and size(new) > 0").select("previous", "raw", "new", F.inline("gone")).select("previous", "raw", "new", F.col("path").alias("x"), "parent", F.col("type").alias("tx"))
    c = g.select("previous", "raw", "x", "parent", "tx", F.inline("new").alias("y", "py", "ty")).filter("parent = py and (tx = ty or tx = 'null' or ty = 'null')").select("previous", "raw", "x", "y")
    names = cut(c.select("x", "y").distinct())
    wanted = names.select(F.explode(F.array("x", "y")).alias("path")).distinct()
    # in how many files each name stands, and both: by layout and the files that have it
    many = _files(reduced_files).groupBy("raw").agg(F.count(F.lit(1)).alias("files"))
    takes = _layouts(reduced_files).select("raw", F.explode("tags").alias("tag")).join(union.join(wanted, "path", "left_semi").select("tag", "path"), "tag")
    stands = cut(takes.join(many, "raw").select("raw", "path", "files"))
    count = stands.groupBy("path").agg(F.sum("files").alias("files"))
    both = names.join(stands.withColumnRenamed("path", "x"), "x").join(stands.select(F.col("path").alias("y"), "raw"), ["y", "raw"]).groupBy("x", "y").agg(F.sum("files").alias("both"))
    counts = reduced_files.filter(F.col("kind") == CONTENT).join(wanted, "path", "left_semi").groupBy("path", "class").agg(F.sum("n").alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("path"))).select("path", "class", "share")
    s = lambda k: share.select(F.col("path").alias(k), "class", F.col("share").alias(f"s{k}"))
    alike = names.join(s("x"), "x").join(s("y"), ["y", "class"]).groupBy("x", "y").agg(F.sum(F.least("sx", "sy")).alias("alike"))
    n = lambda k: count.select(F.col("path").alias(k), F.col("files").alias(f"n{k}"))
    judged = alike.filter(F.col("alike") >= ALIKE).join(n("x"), "x").join(n("y"), "y").join(both, ["x", "y"], "left").filter(F.coalesce("both", F.lit(0)) <= F.lit(TOGETHER) * F.least("nx", "ny"))
    good = c.join(judged.select("x", "y", "alike"), ["x", "y"])
    best = lambda *k: Window.partitionBy("previous", "raw", *k).orderBy(F.desc("alike"), "x", "y")
    ranked = good.withColumn("i", F.row_number().over(best("x"))).withColumn("j", F.row_number().over(best("y"))).filter("i = 1 and j = 1")
    return ranked.groupBy("previous", "raw").agg(F.collect_list(F.struct(F.col("x").alias("path"), F.col("y").alias("new_path"))).alias("renamed"))


def _woken(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, source, field, change, new_field): fields retyped across nulls, by the typed branch that the path left last."""
    some = moves.filter("size(woke) > 0 or size(left) > 0").select("previous", "raw", F.concat(F.transform("woke", lambda f: F.struct(f["path"].alias("path"), f["type"].alias("type"), F.lit(True).alias("woke"))), F.transform("left", lambda f: F.struct(f["path"].alias("path"), f["type"].alias("type"), F.lit(False).alias("woke")))).alias("e"))
    e = steps.join(some, ["previous", "raw"]).select("id", "source", "src", "received", "raw", "chunk", F.inline("e")).withColumn("typed", F.when(~F.col("woke"), F.col("type")))
    seen = carry_last(e, ["src", "path"], "chunk", ["received", "id", "raw"], "typed", "before")
    return seen.filter("woke and before <> type").select("id", "source", F.col("path").alias("field"), F.lit("retyped").alias("change"), F.lit("").alias("new_field"))


def changes(reduced_files: DataFrame) -> DataFrame:
    """(id, source, field, change, new_field) of every change against the file before from the same source."""
    union = cut(fused(reduced_files))
    follows = carry_last(_files(reduced_files), ["src"], "chunk", ["received", "id", "raw"], "raw", "previous").filter("previous is not null and previous <> raw")
    steps = cut(follows.select("id", "source", "src", "received", "chunk", "previous", "raw"))
    moves = cut(_appearing(steps, reduced_files, union))
    s = moves.join(_renames(moves, reduced_files, union), ["previous", "raw"], "left").withColumn("renamed", F.coalesce("renamed", F.array().cast(_NAMES)))
    s = s.withColumn("gone", F.transform("gone", lambda f: f["path"])).withColumn("new", F.transform("new", lambda f: f["path"]))
    s = s.withColumn("old_names", F.transform("renamed", lambda r: r["path"])).withColumn("new_names", F.transform("renamed", lambda r: r["new_path"]))
    step = "struct<field:string,change:string,new_field:string>"
    found = F.expr(f"""cast(concat(
      transform(renamed, r -> struct(r.path as field, 'renamed' as change, r.new_path as new_field)),
      transform(filter(gone, p -> not array_contains(old_names, p)), p -> struct(p as field, 'removed' as change, '' as new_field)),
      transform(filter(new, p -> not array_contains(new_names, p)), p -> struct(p as field, 'added' as change, '' as new_field)),
      transform(retyped, p -> struct(p as field, 'retyped' as change, '' as new_field))) as array<{step}>)""")
    # nothing below a field that changed
    told = "filter(found, c -> not exists(tops, t -> startswith(c.field, concat(t, '.'))))"
    out = s.withColumn("found", found).withColumn("tops", F.expr("concat(gone, new, retyped)")).select("previous", "raw", F.expr(told).alias("found")).filter("size(found) > 0")
    return steps.join(out, ["previous", "raw"]).select("id", "source", F.inline("found")).unionByName(_woken(steps, moves))


def inferred(reduced_files: DataFrame) -> DataFrame:
    """The fused schema: (field, type, files, first_id, alternatives), one row per path and type seen.

    ``alternatives`` are all types of the path, its tagged union; ``first_id`` is the file that brought
    the type (least received, then id), which is where it is reported as appearing.
    """
    by_layout = _files(reduced_files).groupBy("raw").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("received", "id")).alias("first"))
    takes = _layouts(reduced_files).select("raw", F.explode("tags").alias("tag")).join(by_layout, "raw")
    by = takes.groupBy("tag").agg(F.sum("files").alias("files"), F.min("first").alias("first")).join(fused(reduced_files), "tag")
    by = cut(by.select(F.col("path").alias("field"), "type", "files", F.col("first.id").alias("first_id")))
    union = by.filter("type <> 'null'").groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("alternatives"))
    return by.join(union, "field", "left").withColumn("alternatives", F.coalesce("alternatives", F.lit("null")))


def aliases(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, canonical): names that changes say are one field, led to the one among ``wanted`` paths.

    A rename of a map or record is followed below it: the fields of either name count as those of both. Chains of renames are followed.
    """
    last = lambda p: F.substring_index(p, ".", -1)
    # by the parent's name as wanted, so that what was renamed below a renamed parent is seen, too
    edges = found.filter("change = 'renamed'").select(F.col("field").alias("a"), F.col("new_field").alias("b")).distinct()
    comp = connected_components(edges)
    named = comp.join(wanted.select(F.col("field").alias("node")), "node", "left_semi").groupBy("component").agg(F.min("node").alias("canonical"))
    direct = comp.join(named, "component").filter("node <> canonical").select(F.col("node").alias("path"), "canonical")
    # sources.*.cached_tokens says what lanes.*.cached_tokens is
    below = direct.filter("path like '%.%'").select(F.explode(F.array(F.col("path"))).alias("p"), last(F.col("path")).alias("n"), F.col("canonical").alias("c"))
    heads = direct.filter("not path like '%.%'").select(F.col("path").alias("head"), F.col("canonical").alias("h"))
    more = below.join(heads, F.startswith(below["c"], F.concat(heads["h"], F.lit(".")))).select(F.concat("head", F.expr("substring(c, length(h) + 1, length(c) - length(h) - length(substring_index(c, '.', -1)))"), F.col("n")).alias("path"), F.col("c").alias("canonical"))
    return direct.unionByName(more).groupBy("path").agg(F.min("canonical").alias("canonical"))


def _as_integer(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        v = int(v) if abs(v) < 2**63 and v == int(v) else None
    elif isinstance(v, str):
        v = int(v.strip().partition(".")[0]) if re.fullmatch(r"\s*[+-]?[0-9]+(\.0*)?\s*", v) else None
    return v if isinstance(v, int) and -(2**63) <= v < 2**63 else None


def _as_boolean(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) and v in (0, 1):
        return bool(v)
    if isinstance(v, str):
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(v.strip().lower())
    return None


def _as_string(v, field: str):
    if isinstance(v, str):
        return _clean(v)
    if isinstance(v, dict):  # one field of an object that names it
        return next((_clean(x) for k in ("id", "name", "value") if isinstance(x := v.get(k), str)), None)
    if isinstance(v, int) and not isinstance(v, bool) and field.endswith("_at"):  # seconds since 1970
        from datetime import datetime, timedelta, timezone

        try:
            return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=v)).isoformat()
        except OverflowError:
            return str(v)
    return None if v is None or isinstance(v, (list, bool)) else str(v)


def _as_array(v):
    if isinstance(v, str):
        return [_clean(x) for x in re.split(r"[,;\s]+", v) if x]
    return [_clean(x) if isinstance(x, str) else _json(x) for x in v] if isinstance(v, list) else None


def _as_number(v):
    try:
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    except OverflowError:
        return None


def _json(v) -> str:
    """JSON text of a value as it was read; a number beyond a double is written as it can be read again."""
    text = json.dumps(v)
    return re.sub(r'("(?:[^"\\]|\\.)*")|Infinity', lambda m: m[1] or "1e999", text) if "Infinity" in text else text


def _as_map(v):
    """A map of objects; a list of objects that name themselves is one, too. A list of (name, number) has no fields to take."""
    if isinstance(v, dict):
        return {_clean(k): x for k, x in v.items() if isinstance(x, dict)}
    if isinstance(v, list):
        named = {_clean(x["name"]): x for x in v if isinstance(x, dict) and isinstance(x.get("name"), str)}
        return named or None
    return None


def _siblings(names: dict[str, str]) -> dict[str, str]:
    """What a name below one object says holds below its siblings, if it says the same everywhere: last name to last name."""
    says: dict[str, set] = {}
    for old, new in names.items():
        if "." in old:
            says.setdefault(old.rpartition(".")[2], set()).add(new.rpartition(".")[2])
    return {k: min(v) for k, v in says.items() if len(v) == 1}


def named_files(files: DataFrame, id: str, reduced_files: DataFrame, names: DataFrame) -> DataFrame:
    """``files`` with ``_names`` and ``_alike``: the names (path, canonical) that concern a file's own fields, and those of siblings.

    For more names than a worker should hold: they meet the layouts, which are few, and files by their layout's digest.
    """
    last = lambda p: F.substring_index(p, ".", -1)
    paths = _layouts(reduced_files).select("raw", F.explode("tags").alias("tag")).join(fused(reduced_files).select("tag", "path"), "tag").select("raw", "path").distinct()
    says = names.filter("path like '%.%'").groupBy(last("path").alias("last")).agg(F.min(last("canonical")).alias("x"), F.max(last("canonical")).alias("y")).filter("x = y").select("last", F.col("x").alias("to"))
    as_map = lambda k, v, name: F.map_from_entries(F.collect_list(F.struct(k, v))).alias(name)
    own = paths.join(names, "path").groupBy("raw").agg(as_map("path", "canonical", "_names"))
    near = paths.select("raw", last("path").alias("last")).distinct().join(says, "last").groupBy("raw").agg(as_map("last", "to", "_alike"))
    by_file = _files(reduced_files).select(F.col("id").alias("_file"), "raw").join(own, "raw", "left").join(near, "raw", "left").drop("raw").dropDuplicates(["_file"])
    none = F.create_map().cast("map<string,string>")
    return files.join(by_file, files[id].cast("long") == by_file["_file"]).drop("_file").withColumns({c: F.coalesce(c, none) for c in ("_names", "_alike")})


def consistent(files: DataFrame, id: str, source: str, received: str, body: str, fields: list[tuple[str, str]], names: dict[str, str] | None) -> DataFrame:
    """Every readable file as one row of one schema: id, source, received, a column per field, ``branches``.

    ``fields`` are dotted paths with their types, as ``read`` gives them: top-level scalars, arrays, objects of integers, and
    maps (``m.*.x``) of those. ``names`` leads a path under another name to the wanted one; without it ``files`` come from ``named_files``. A value of another
    type, or an integer beyond 64 bits, takes the canonical conversion (digits to integers, 0/1 and words to booleans, seconds since 1970 to
    stamps, an object to what names it, separated text to arrays, lists of named objects to maps), or null where
    there is none; either way its JSON text is kept in ``branches``, a map of ``path:type``. So is every field, at any
    depth, that is not taken, every entry of a map that is no object, and, under its own path, the value that gives way
    where two names lead to one field, so nothing is lost. Keys that become equal when cleaned get a number.
    """
    tops = [(f, t) for f, t in fields if "." not in f]
    under = {f: [x.rpartition(".")[2] for x, _ in fields if x.rpartition(".")[0] in (f, f"{f}.*")] for f, _ in tops}
    maps = {f for f, _ in tops if any(x.startswith(f"{f}.*.") for x, _ in fields)}
    kinds = {"integer": "long", "string": "string", "boolean": "boolean", "array": "array<string>", "number": "double"}

    def ddl(f: str, t: str) -> str:
        if t != "object":
            return f"`{f}` {kinds[t]}"
        struct = "struct<" + ",".join(f"`{x}`:long" for x in under[f]) + ">"
        return f"`{f}` map<string,{struct}>" if f in maps else f"`{f}` {struct}"

    for_all = None if names is None else (names, _siblings(names))

    ddl_all = ", ".join(["_id long", "_source string", "_received timestamp", *(ddl(f, t) for f, t in tops), "branches map<string,string>"])
    schema = to_arrow_schema(StructType.fromDDL(ddl_all))

    def keep(path: str, v, branches: dict) -> None:
        key, nth = f"{path}:{_kind(v)}", 2
        while key in branches:
            key, nth = f"{path}:{_kind(v)}#{nth}", nth + 1
        branches[key] = _json(v)

    def take(path: str, want: str, v, branches: dict):
        kind = _kind(v)
        if v is not None and (kind != want or (want == "integer" and _as_integer(v) is None)):
            keep(path, v, branches)
        if want == "integer":
            return _as_integer(v)
        if want == "boolean":
            return _as_boolean(v)
        if want == "string":
            return _as_string(v, path)
        if want == "array":
            return _as_array(v)
        return _as_number(v)

    def renamed(o: dict, at: str, label: str, branches: dict, told: tuple[dict, dict]) -> dict:
        """The object's fields by their wanted names; one that has the wanted name itself wins, the other is kept in branches."""
        out: dict = {}
        came: dict = {}
        for k, v in o.items():
            path = f"{at}.{_clean(k)}" if at else _clean(k)
            new = told[0].get(path, told[1].get(_clean(k), path) if at else path).rpartition(".")[2]
            if new == path.rpartition(".")[2] or new not in out:
                if new in out:
                    keep(label + came[new], out[new], branches)
                out[new], came[new] = v, _clean(k)
            else:
                keep(label + _clean(k), v, branches)
        return out

    def tokens(o: dict, old: str, f: str, branches: dict, label: str, told: tuple[dict, dict]) -> dict:
        r = renamed(o, old, f"{label}.", branches, told)
        for k, v in r.items():
            if k not in under[f]:
                keep(f"{label}.{_clean(k)}", v, branches)
        return {x: take(f"{label}.{x}", "integer", r.get(x), branches) for x in under[f]}

    def row(o: dict, told: tuple[dict, dict]) -> dict:
        branches: dict = {}
        back = {told[0][k]: k for k in o if k in told[0] and "." not in k}
        r = renamed(o, "", "", branches, told)
        out = {}
        for f, t in tops:
            v = r.get(f)
            if t != "object":
                out[f] = take(f, t, v, branches)
                continue
            old = back.get(f, f) if f not in o else f
            if v is not None and not isinstance(v, dict):
                keep(f, v, branches)
            if f in maps:
                m = _as_map(v)
                if isinstance(v, dict):
                    for k, x in v.items():
                        if not isinstance(x, dict) or m[_clean(k)] is not x:
                            keep(f"{f}.{_clean(k)}", x, branches)
                out[f] = None if m is None else [(k, tokens(x, f"{old}.*", f, branches, f"{f}.{k}", told)) for k, x in m.items()]
            else:
                out[f] = tokens(v, old, f, branches, f, told) if isinstance(v, dict) else None
        wanted = {f for f, _ in tops}
        for k, v in r.items():
            if k not in wanted:
                keep(_clean(k), v, branches)
        out["branches"] = list(branches.items())
        return out

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            told = repeat(for_all) if for_all else ((dict(n), dict(a)) for n, a in zip(batch.column("_names").to_pylist(), batch.column("_alike").to_pylist()))
            for i, s, r, b, t in zip(*(batch.column(n).to_pylist() for n in ("id", "source", "received", "body")), told):
                o = read_object(b)
                if o is not None:
                    try:
                        out.append({"_id": i, "_source": s, "_received": r} | row(o, t))
                    except RecursionError:  # nested too deeply to be followed
                        continue
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    narrow = files.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), F.col(received).alias("received"), F.col(body).alias("body"), *([] if for_all else ["_names", "_alike"]))
    return narrow.mapInArrow(read, ddl_all)

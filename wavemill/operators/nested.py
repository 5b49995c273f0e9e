"""Deeply nested JSON records as related flat tables.

Each record is parsed into cells: path, value and ordinals. The path is told in
two parts, the innermost repeated ancestor (the table, ``authors[].units[]``)
and the column below it (``name``); the ordinals are the places in the arrays on
the way. Cells with the same repeated ancestor make one table, whose rows are
the ordinals, and pivoting them by column gives the table. A row's ordinals
without the last one are those of its parent. No path need be known beforehand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "path string, ordinals array<int>, field string, kind string, value string"
#: More columns than this in one pivoted table are told by name instead (``columns``); a field whose keys are data has as many as it has keys.
MOST_COLUMNS = 2_000

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))', re.ASCII)
_MARKS = re.compile(r'[\\.\["]')
_END = re.compile(r"[ \t\n\r]*\Z")


class Number(str):
    """A number as written."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def decoder() -> json.JSONDecoder:
    """Reads numbers as written. Of a key told twice in one object, the last one counts."""
    return json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def parse(text: str, reader: json.JSONDecoder) -> Any:
    """The value of a JSON text, however deep; a ValueError if it isn't one."""
    try:
        return reader.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """The same token by token, open objects and arrays on a stack of our own, so depth has no limit."""
    stack: list[Any] = []
    keys: list[str] = []
    pos, expect, result = 0, "value", None

    def put(value: Any) -> str:
        nonlocal result
        if not stack:
            result = value
            return "end"
        if isinstance(stack[-1], dict):
            stack[-1][keys.pop()] = value
        else:
            stack[-1].append(value)
        return "sep"

    while expect != "end":
        if (m := _TOKEN.match(text, pos)) is None:
            raise ValueError("not JSON")
        pos = m.end()
        mark, quote, number, word = m.groups()
        if quote and expect != "sep":
            value, pos = scanstring(text, pos, True)
            if expect.startswith("key"):
                if (m := _TOKEN.match(text, pos)) is None or m[1] != ":":
                    raise ValueError("not JSON")
                pos = m.end()
                keys.append(value)
                expect = "value"
            else:
                expect = put(value)
        elif expect.startswith("value") and (number is not None or word):
            expect = put(Number(number) if number is not None else {"true": True, "false": False, "null": None}[word])
        elif expect.startswith("value") and mark in ("{", "["):
            stack.append({} if mark == "{" else [])
            expect = "key or }" if mark == "{" else "value or ]"
        elif mark and (expect.endswith(mark) or expect == "sep" and mark == ("}" if isinstance(stack[-1], dict) else "]")):
            expect = put(stack.pop())
        elif expect == "sep" and mark == ",":
            expect = "key" if isinstance(stack[-1], dict) else "value"
        else:
            raise ValueError("not JSON")
    if not _END.match(text, pos):
        raise ValueError("not JSON")
    return result


_LIST, _HERE, _ALL = 0, 1, 2


def _steps(lists: Iterable[tuple[str, ...]], only: Iterable[tuple[str, ...]] | None) -> dict:
    """Paths as a tree of steps."""
    root: dict = {} if only is not None else {_ALL: True}
    for mark, paths in ((_LIST, lists), (_HERE, only or ())):
        for p in paths:
            node, own = root, mark
            for step in p:
                if step == "**":
                    own = _ALL
                    break
                node = node.setdefault(step, {})
            node[own] = True
    return root


def _escaped(key: str) -> str:
    if key and not _MARKS.search(key):
        return key
    return _MARKS.sub(r"\\\g<0>", key) or '""'


_NOTHING: dict = {}


def cells(value: Any, steps: dict) -> Iterator[tuple[str, tuple[int, ...], str, str, str | None]]:
    """``(path, ordinals, field, kind, value)`` of everything in a parsed value that ``steps`` asks for. ``kind``: string, number, bool, null, object, array."""
    stack = [(value, "", (), "", steps, _ALL in steps)]
    while stack:
        v, table, ordinals, field, node, every = stack.pop()
        if _LIST in node and v is not None and not isinstance(v, list):
            v = [v]
        every = every or _ALL in node
        told = every or _HERE in node
        if isinstance(v, dict):
            if told:
                yield table, ordinals, field, "object", None
            for k, x in v.items():
                child = node.get(k) or node.get("*")
                if every or child:
                    k = _escaped(k)
                    stack.append((x, table, ordinals, f"{field}.{k}" if field else k, child or _NOTHING, every))
        elif isinstance(v, list):
            if told:
                yield table, ordinals, field, "array", None
            child = node.get("[]")
            if every or child:
                inner = f"{table}.{field}[]" if table and field else f"{table}{field}[]"
                for i, x in enumerate(v):
                    stack.append((x, inner, (*ordinals, i), "", child or _NOTHING, every))
        elif told:
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, Number) else "string"
            yield table, ordinals, field, kind, str(v).lower() if kind == "bool" else v


def shred(records: DataFrame, key: str, text: str, lists: Iterable[tuple[str, ...]] = (), only: Iterable[tuple[str, ...]] | None = None) -> DataFrame:
    """Cells of each record: ``key, path, ordinals, field, kind, value``. Invalid texts and null keys give no rows.

    ``lists``: paths at which a lone element counts as a list of one (a null is
    none). ``only``: the paths wanted, all if not given; a path is a tuple of
    keys, ``[]`` for an array's elements and ``*`` for any key, and takes in all
    below it if it ends with ``**``. Other parts of a record give no rows. Dots,
    brackets, quotes and backslashes in keys are told with a backslash before
    them, an empty key as two quotes.
    """
    steps = _steps(lists, only)
    arrow = pa.schema([("k", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("field", pa.string()), ("kind", pa.string()), ("value", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        try:
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
        except UnicodeEncodeError:  # lone surrogates can't be stored as UTF-8
            arrays = [pa.array(map(_clean, c) if f.type == pa.string() else c, f.type) for c, f in zip(columns, arrow, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = decoder()
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    value = parse(t.as_py(), reader)
                except ValueError:
                    continue
                for c in cells(value, steps):
                    rows.append((k, *c))
                    if len(rows) >= 20_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    source = records.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return source.mapInArrow(run, f"k long, {CELLS}").withColumnRenamed("k", key)


def found_tables(found: DataFrame, most: int = MOST_COLUMNS) -> dict[str, list[str]]:
    """The repeated ancestors in shredded records, each with the fields below it. One row per path comes to the driver; a table of more than ``most`` fields is an error, its columns must be named."""
    paths = found.select("path", "field").distinct()
    wide = paths.groupBy("path").count().where(F.col("count") > most).select("path").first()
    if wide:
        raise ValueError(f"{wide['path'] or 'the root'} has more than {most} fields: name the columns wanted")
    out: dict[str, list[str]] = {}
    for r in paths.groupBy("path").agg(F.sort_array(F.collect_list("field")).alias("fields")).collect():  # at most ``most`` fields each
        out[r["path"]] = r["fields"]
    return out


def pivoted(found: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row for each place of each table in ``found``: ``key, path, ordinals`` and a ``struct<kind, value>`` for each name in ``fields`` (name to field; the element itself is the field without a name). A field that the row lacks is null."""
    each = [F.max(F.when(F.col("field") == f, F.struct("kind", "value"))).alias(n) for n, f in fields.items()]
    return found.groupBy(key, "path", "ordinals").agg(*each)


def flat_tables(records: DataFrame, key: str, text: str, columns: dict[str, list[str]] | None = None, lists: Iterable[tuple[str, ...]] = ()) -> dict[str, DataFrame]:
    """Every table in the records by its repeated ancestor (the root's is ''), found in the data: ``key, parent, ordinals`` and a column of text for each field.

    ``parent`` are the ordinals of the row of the table above it, null in the
    root; arrays directly in arrays count as tables of their own. The element
    itself is the column ``value``. ``columns`` gives the fields of some tables
    instead of looking for them. A key told twice in ``records`` should be
    removed before (:func:`once`). Objects and arrays are null as columns.
    """
    from wavemill.session import written

    found = written(shred(records, key, text, lists), "cells")
    out = {}
    for table, fields in (columns or found_tables(found)).items():
        names = {f"f{i}": f for i, f in enumerate(fields)}
        rows = pivoted(found.where(F.col("path") == table), key, names)
        parent = F.expr("slice(ordinals, 1, size(ordinals) - 1)") if table else F.lit(None).cast("array<int>")
        out[table] = rows.select(key, parent.alias("parent"), "ordinals", *[F.col(f"{n}.value").alias(f or "value") for n, f in names.items()])
    return out


def _clean(value: str | None) -> str | None:
    """Lone surrogates can't be stored as UTF-8."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def once(df: DataFrame, key: str, *rest: str, arrival: str | None = None) -> DataFrame:
    """One row per ``key``: of repeats the first to arrive. Rows with a null key are left out."""
    order = F.struct(*[F.col(arrival)] if arrival else [], *rest)
    # A fixed number of partitions: what follows is work for Python, too much for the few that the small bytes suggest.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = df.where(F.col(key).isNotNull()).repartition(n, key).groupBy(key).agg(F.min(order).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --- project metadata ----------------------------------------------------

# The keys an entry's content may be under, and the lists in it
# with the key that holds the value of an element that is an object.
CONTENT_KEYS = ["application", "operator", "workflow", "tutorial", "benchmark", "gxf_extension", "package"]
CHILD_LISTS = {
    "author": (["authors"], "name"),
    "tag": (["tags"], "name"),
    "tested_version": (["holoscan_sdk", "tested_versions"], "version"),
}
ROOT_FIELDS = {"name": "name", "version": "version", "minimum_required_version": "holoscan_sdk.minimum_required_version"}

#: An entry alone is a list of one, and so is an element alone.
_LISTS = [(), *(("[]", k, *at) for k in CONTENT_KEYS for at, _ in CHILD_LISTS.values())]


def _blank(c: Column) -> Column:
    """Without outer blanks; null if nothing remains."""
    s = F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
    return F.when(s != "", s)


def _told(c: str) -> Column:
    """The text or number in a pivoted field."""
    return F.when(F.col(f"{c}.kind").isin("string", "number"), F.col(f"{c}.value"))


def _records(records: DataFrame, only: list[tuple[str, ...]]) -> DataFrame:
    return shred(once(records, "record_id", "raw_json", arrival="ingested_at"), "record_id", "raw_json", _LISTS, only)


def _content() -> Column:
    """The place in ``CONTENT_KEYS`` of the key that a table's path has first."""
    key = F.split(F.col("path"), r"[.\[]")[2]
    return F.array_position(F.array(*[F.lit(x) for x in CONTENT_KEYS]), key).cast("int")


def metadata_children(records: DataFrame) -> DataFrame:
    """Authors, tags and tested versions of metadata records: ``record_id, entry_no, child_kind, pos, child_value``.

    The rows of the tables of these three lists. A record counts once however
    often it was delivered. A list's element is text, a number as written, or an
    object with the value under the list's key; a lone element counts as a list
    of one. Elements without a value, or blank, give no row but keep their
    place. Invalid and empty texts, null ids and entries under other keys give
    nothing. Two content keys in one entry: the first in the order of
    ``CONTENT_KEYS``.
    """
    only = [("[]", k, *at, "[]", *more) for k in CONTENT_KEYS for at, key in CHILD_LISTS.values() for more in ((), (key,))]
    rows = pivoted(_records(records, only), "record_id", {"own": "", **{f"at_{key}": key for _, key in CHILD_LISTS.values()}})
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (at, key) in CHILD_LISTS.items():
        here = F.col("path").endswith(f".{'.'.join(at)}[]")
        kind, value = F.when(here, F.lit(name)).otherwise(kind), F.when(here, F.coalesce(_told("own"), _told(f"at_{key}"))).otherwise(value)
    rows = rows.select("record_id", F.col("ordinals")[0].alias("entry_no"), F.col("ordinals")[1].alias("pos"), kind.alias("child_kind"), _blank(value).alias("child_value"), _content().alias("rank"))
    first = rows.where("child_value is not null").groupBy("record_id", "entry_no", "child_kind", "pos").agg(F.min(F.struct("rank", "child_value")).alias("v"))
    return first.select("record_id", "entry_no", "child_kind", "pos", F.col("v.child_value").alias("child_value"))


def metadata_projects(records: DataFrame) -> DataFrame:
    """One row per entry with content: ``record_id, entry_no, content, name, version, minimum_required_version, n_authors, n_tags``.

    The parent table of :func:`metadata_children`; the last two count places in the
    lists, filled or not. Fields that are missing or not plain values are null.
    """
    content = [("[]", k) for k in CONTENT_KEYS]
    only = [*content, *((*c, *f.split(".")) for c in content for f in ROOT_FIELDS.values()), *((*c, *CHILD_LISTS[n][0], "[]") for c in content for n in ("author", "tag"))]
    found = _records(records, only)
    entry = found.where("path = '[]'").withColumn("content", F.split_part("field", F.lit("."), F.lit(1)))
    entry = entry.withColumn("path", F.concat(F.lit("[]."), "content")).withColumn("field", F.expr("substring(field, length(content) + 2)"))
    projects = pivoted(entry.drop("content"), "record_id", ROOT_FIELDS)
    projects = projects.select("record_id", F.col("ordinals")[0].alias("entry_no"), F.expr("substring(path, 4)").alias("content"), *[_blank(_told(n)).alias(n) for n in ROOT_FIELDS])
    listed = F.split("path", r"[.\[]")
    children = pivoted(found.where("path <> '[]'"), "record_id", {"own": ""})
    counts = children.groupBy("record_id", F.col("ordinals")[0].alias("entry_no"), listed[2].alias("content")).agg(*[F.count_if(F.col("path").endswith(f".{x}[]")).alias(f"n_{x}") for x in ("authors", "tags")])
    return projects.join(counts, ["record_id", "entry_no", "content"], "left").fillna(0, ["n_authors", "n_tags"])


def metadata_libraries(records: DataFrame) -> DataFrame:
    """Libraries that entries depend on: ``record_id, entry_no, content, pos, name, version``, every place in the list."""
    at = ("dependencies", "libraries", "[]")
    only = [("[]", k, *at, *more) for k in CONTENT_KEYS for more in ((), ("name",), ("version",))]
    rows = pivoted(_records(records, only), "record_id", {"name": "name", "version": "version"})
    return rows.select("record_id", F.col("ordinals")[0].alias("entry_no"), F.split("path", r"[.\[]")[2].alias("content"), F.col("ordinals")[1].alias("pos"), _blank(_told("name")).alias("name"), _blank(_told("version")).alias("version"))

"""Deeply nested semi-structured records into related flat tables.

``flatten_records`` infers a merged schema over all records and explodes every array level recursively into a child
table whose rows carry the surrogate key of their parent (record key and ordinals of the levels above) and their own
ordinal. Records that come as text from a model are brought into one shape first (``canonical_records``): what wraps or
surrounds the record is dropped, encoded parts are decoded, and wherever some record has a list, every record gets one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.session import materialize, read_table

#: An object with more different keys than these, over all records, is keyed by data: it stands for the list of its entries.
#: Bound of what schema inference then sends to the driver: distinct paths of the merged schema.
MAX_KEYS, MAX_PATHS = 500, 100_000
_DECODER = json.JSONDecoder(parse_constant=lambda x: None)


def _decoded(v):
    """v, or what it encodes if it is the JSON text of an object, a list or a string."""
    while isinstance(v, str) and v.strip()[:1] in ("{", "[", '"'):
        try:
            v = json.loads(v.strip().lstrip("﻿"))
        except ValueError:
            break
    return v


def _is_record(v, keys: frozenset[str], least: int) -> bool:
    return isinstance(v, dict) and sum(k in v for k in keys) >= least


def _unwrapped(v, keys: frozenset[str], least: int, depth: int = 0):
    """The record in v or in what v wraps (an object, a list or encoded text), or None."""
    v = _decoded(v)
    if _is_record(v, keys, least):
        return v
    if depth < 6 and isinstance(v, (dict, list)):
        for x in v.values() if isinstance(v, dict) else v:
            if isinstance(x, (dict, list, str)) and (found := _unwrapped(x, keys, least, depth + 1)) is not None:
                return found
    return None


def extract_record(text: str | None, keys: frozenset[str], least: int = 2):
    """The first complete record in a text, or None. A record is an object with at least ``least`` of the keys."""
    if not text:
        return None
    if (found := _unwrapped(text, keys, least)) is not None:
        return found
    at, end = 0, len(text)
    while at < end:
        starts = [p for p in (text.find("{", at), text.find('"{', at), text.find("[", at)) if p >= 0]
        if not starts:
            break
        at = min(starts)
        try:
            v, stop = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        if (found := _unwrapped(v, keys, least)) is not None:
            return found
        at = max(stop, at + 1)
    return None


def _entries(v, fields: frozenset[str]) -> list:
    """The entries of what stands at a list's place."""
    v = _decoded(v)
    if v is None:
        return []
    if isinstance(v, list):
        out = []
        for x in v:
            x = _decoded(x)
            out.extend(_entries(x, fields) if isinstance(x, list) else [x])
        return out
    if isinstance(v, dict) and v and not any(k in fields for k in v):
        out = []
        for x in v.values():
            out.extend(_entries(x, fields) if isinstance(_decoded(x), list) else [_decoded(x)])
        return out
    return [] if isinstance(v, dict) and not v else [v]


def _shaped(v, path: str, lists: dict[str, frozenset[str]], objects: frozenset[str]):
    """v with a list at each path of lists and an object (or nothing) at each path of objects."""
    if path in lists:
        return [_shaped(x, path + "[]", lists, objects) for x in _entries(v, lists[path])]
    if path in objects:
        v = _decoded(v)
        if v is None:
            return None
        if not isinstance(v, dict):
            return {"id": _scalar(v)} if path.endswith("[]") else None
        return {k: _shaped(x, f"{path}.{k}", lists, objects) for k, x in v.items()}
    return _scalar(v)


def _scalar(v):
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


class Paths:
    """The places of records with what stands there, one path per place: the entries of an object at a list's place, and of
    one that is keyed by data, are all at path[]."""

    def __init__(self, declared: dict[str, frozenset[str]]):
        self.declared = declared
        self.kinds: dict[tuple[str, str], int] = {}
        self.keys: dict[str, set[str]] = {}
        self.maps: set[str] = set()

    def add(self, path: str, kind: str, n: int = 1) -> None:
        self.kinds[path, kind] = self.kinds.get((path, kind), 0) + n

    def walk(self, v, path: str = "$") -> None:
        v = _decoded(v)
        if isinstance(v, list):
            self.add(path, "list")
            for x in v:
                self.walk(x, path + "[]")
        elif isinstance(v, dict):
            if path in self.maps or path in self.declared and v and not any(k in self.declared[path] for k in v):
                self.add(path, "list")
                for x in v.values():
                    x = _decoded(x)
                    for y in x if isinstance(x, list) else [x]:
                        self.walk(y, path + "[]")
                return
            self.add(path, "object")
            self.keys.setdefault(path, set()).update(v)
            for k, x in v.items():
                self.walk(x, f"{path}.{k}")
            self.fold(path)
        elif v is not None:
            self.add(path, "value")

    def fold(self, path: str) -> None:
        """Once an object has too many keys, all that was seen below its keys stands at its entries' place."""
        if path in self.maps or len(self.keys.get(path, ())) <= MAX_KEYS:
            return
        self.maps.add(path)
        below = re.compile(re.escape(path) + r"\.[^.\[]*")
        old, self.kinds = self.kinds, {}
        for (p, kind), n in old.items():
            at = below.match(p)
            self.add(path + "[]" + p[at.end():] if at else p, "list" if p == path and kind == "object" else kind, n)
        self.keys = {below.sub(lambda m: path + "[]", p, count=1) if below.match(p) else p: k for p, k in self.keys.items() if p != path}


def _folded(found: DataFrame) -> DataFrame:
    """The paths of all tasks with those below objects that have too many keys in all of them together at one place."""
    while found.count() > MAX_KEYS:
        child = r"^(.*)\.[^.\[]*$"
        many = found.filter(F.col("path").rlike(child)).select(F.regexp_extract("path", child, 1).alias("p"), "path").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("k"))
        # an outermost one at a time, as those inside it move with it
        top = many.filter(F.col("k") > MAX_KEYS).orderBy(F.length("p"), "p").first()
        if top is None:
            return found
        below = "^" + re.escape(top.p) + r"\.[^.\[]*"
        kind = F.when((F.col("path") == top.p) & (F.col("kind") == "object"), "list").otherwise(F.col("kind"))
        path = F.regexp_replace("path", below, re.escape(top.p + "[]"))
        found = materialize(found.select(path.alias("path"), kind.alias("kind"), "n").groupBy("path", "kind").agg(F.sum("n").alias("n")), "paths")
    return found


def infer_shape(records: DataFrame, text: str, keys: list[str], least: int = 2, declared: dict[str, list[str]] | None = None) -> tuple[dict[str, frozenset[str]], frozenset[str]]:
    """The merged schema of all records of a text column: list paths with the fields of their elements, and object paths.

    Every record is read; counts of (path, kind) are aggregated on the executors. A path at which any record has a list
    is a list path, and so are the declared ones (path -> some fields of its elements), which few or no records may show;
    names below an object that stands at a list's place, or that has more than MAX_KEYS different keys, are no part of the
    schema: they are data. Only a schema of more than MAX_PATHS fields raises ValueError.
    """
    wanted, known = frozenset(keys), {p: frozenset(f) for p, f in (declared or {}).items()}

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Paths(known)  # one for the whole task, so that it sends each place once
        for pdf in batches:
            for s in pdf[text]:
                if (v := extract_record(s, wanted, least)) is not None:
                    seen.walk(v)
        yield pd.DataFrame([(p, k, n) for (p, k), n in seen.kinds.items()], columns=["path", "kind", "n"]).astype({"n": "int64"})

    found = records.select(text).mapInPandas(paths, "path string, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n"))
    found = materialize(_folded(materialize(found, "paths")), "paths")
    rows = found.limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(f"the records have more than {MAX_PATHS} distinct paths")
    kinds: dict[str, set[str]] = {}
    for r in rows:
        kinds.setdefault(r.path, set()).add(r.kind)
    lists: dict[str, frozenset[str]] = {}
    objects: set[str] = set()
    for p in {*kinds, *(declared or {})}:
        if p in (declared or {}) or "list" in kinds[p]:
            elem = p + "[]"
            lists[p] = frozenset(q[len(elem) + 1:].split(".")[0].split("[]")[0] for q in kinds if q.startswith(elem + ".")) | frozenset((declared or {}).get(p, ()))
            if (declared or {}).get(p):
                objects.add(elem)
    for p in kinds:
        if "object" in kinds[p] and p not in lists:
            objects.add(p)
    keyed = tuple(p + "." for p in lists)  # names of entries
    return {p: f for p, f in lists.items() if not p.startswith(keyed)}, frozenset(p for p in objects if not p.startswith(keyed))


def canonical_records(df: DataFrame, key: str, text: str, keys: list[str], least: int = 2, declared: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, record): the complete record of each text as JSON of one shape; texts without one give no row.

    NULL, empty, broken and truncated texts give no row; other columns of df are ignored; repeated rows come out repeated.
    """
    lists, objects = infer_shape(df, text, keys, least, declared)
    wanted = frozenset(keys)

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, out = [], []
            for a, s in zip(pdf[key], pdf[text]):
                if (v := extract_record(s, wanted, least)) is not None:
                    k.append(a)
                    out.append(json.dumps(_shaped(v, "$", lists, objects), ensure_ascii=False))
            yield pd.DataFrame({key: pd.Series(k, dtype=pdf[key].dtype), "record": pd.Series(out, dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(shaped, f"`{key}` {kind}, record string")


def _as_text(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_as_text(t.elementType))
    return T.StringType()


def merged_schema(records: DataFrame, text: str) -> T.StructType:
    """The schema that holds all JSON texts of a column; leaves are strings. No records give an empty schema."""
    ddl = records.agg(F.schema_of_variant_agg(F.parse_json(text))).first()[0]
    if not ddl or not ddl.startswith("OBJECT"):
        return T.StructType([])
    t = T._parse_datatype_string(ddl.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING"))
    return _as_text(t)


def flatten_records(records: DataFrame, key: str, text: str, schema: T.StructType) -> dict[str, DataFrame]:
    """path -> flat table. The root's table is ``$``; each array level below adds a table named by its path.

    A child table has the record's key, the ordinals (from 1) of the levels above as pos_1, pos_2, ... and its own as the
    last of them, then its scalar fields; scalars of nested objects come as object_field. The parent of a row is the row
    of the parent table with the same key and the same ordinals but the last. A list of scalars has the column ``value``.
    """
    tables: dict[str, DataFrame] = {}

    def visit(df: DataFrame, at: Column, t: T.DataType, path: str, depth: int, kept: list[str]) -> None:
        scalars: list[tuple[str, Column]] = []
        arrays: list[tuple[str, Column, T.DataType]] = []

        def fields(c: Column, s: T.StructType, prefix: str, where: str) -> None:
            for f in s.fields:
                x, name = c.getField(f.name), f"{prefix}{f.name}"
                if isinstance(f.dataType, T.StructType):
                    fields(x, f.dataType, name + "_", f"{where}.{f.name}")
                elif isinstance(f.dataType, T.ArrayType):
                    arrays.append((f"{where}.{f.name}", x, f.dataType.elementType))
                else:
                    scalars.append((name, x))

        if isinstance(t, T.StructType):
            fields(at, t, "", path)
        elif isinstance(t, T.ArrayType):
            arrays.append((path + "[]", at, t.elementType))
        else:
            scalars.append(("value", at))
        taken = set(kept)
        tables[path] = df.select(*kept, *[c.alias(n if n not in taken else f"{n}_1") for n, c in scalars])
        for sub, c, elem in arrays:
            pos = f"pos_{depth + 1}"
            child = df.select(*kept, F.posexplode(c).alias("_p", "_e")).select(*kept, (F.col("_p") + 1).cast("bigint").alias(pos), "_e")
            visit(child, F.col("_e"), elem, sub, depth + 1, [*kept, pos])

    # parsed once; each table reads the columns it needs of that
    parsed = materialize(records.select(key, F.from_json(text, schema).alias("_r")), "parsed") if schema.fields else records.select(key, F.lit(None).cast(schema).alias("_r"))
    visit(parsed, F.col("_r"), schema, "$", 0, [key])
    return tables


#: The top-level keys by which an audit record is told from other objects.
AUDIT_KEYS = ["schema_version", "target_paper", "candidate_reasoning", "evidence_assessments", "fact_coverage", "decision"]
_FACT, _ASSESS, _COVER = "$.candidate_reasoning.candidate_facts", "$.evidence_assessments", "$.fact_coverage"
#: kind -> path of its table, its key
AUDIT_KINDS = {
    "fact": (_FACT, "fact_id"), "fact_reference": (_FACT + ".nearby_reference_ids", "id"),
    "assessment": (_ASSESS, "reference_id"), "assessment_figure": (_ASSESS + ".relevant_figure_ids", "id"),
    "coverage": (_COVER, "fact_id"), "coverage_reference": (_COVER + ".eligible_oa_primary_reference_ids", "id"),
}
#: The list paths of an audit and fields by which a lone element is told from an object that holds several.
AUDIT_LISTS = {
    _FACT: ["fact_id", "statement"], _FACT + "[].nearby_reference_ids": ["id"],
    _ASSESS: ["reference_id", "support_level"], _ASSESS + "[].relevant_figure_ids": ["id"],
    _COVER: ["fact_id", "covered"], _COVER + "[].eligible_oa_primary_reference_ids": ["id"],
}


def audit_tables(audits: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of feasibility_audit.audit_json, by path."""
    records = materialize(canonical_records(audits, "audit_id", "audit_json", AUDIT_KEYS, declared=AUDIT_LISTS), "audit-records")
    return flatten_records(records, "audit_id", "record", merged_schema(records, "record"))


def audit_children(audits: DataFrame) -> DataFrame:
    """One row per element of the audits' lists: audit_id, child_kind, parent_pos, child_pos, child_key."""
    tables = audit_tables(audits)
    out = None
    for kind, (path, field) in AUDIT_KINDS.items():
        if path not in tables:
            continue
        t = tables[path]
        deep = "pos_2" in t.columns
        key = F.coalesce(*[F.col(c) for c in (field, "value", "id") if c in t.columns], F.lit(""))
        rows = t.select(
            F.col("audit_id").cast("bigint").alias("audit_id"), F.lit(kind).alias("child_kind"), (F.col("pos_1") if deep else F.lit(0)).cast("bigint").alias("parent_pos"),
            F.col("pos_2" if deep else "pos_1").cast("bigint").alias("child_pos"), key.alias("child_key"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return audits.sparkSession.createDataFrame([], "audit_id bigint, child_kind string, parent_pos bigint, child_pos bigint, child_key string")
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return audit_children(read_table(spark, d, "feasibility_audit"))


def p5_child_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table and audit."""
    return p5_found(spark, d).groupBy("audit_id", "child_kind").agg(F.count(F.lit(1)).alias("n_rows"), F.max("child_pos").alias("max_pos"))


QUERIES = {"p5_found": p5_found, "p5_child_counts": p5_child_counts}
SQL: dict[str, str] = {}

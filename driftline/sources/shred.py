"""Nested documents as relational tables, one for each repeated path."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass
class Options:
    """only and exclude are parts of paths: with `only`, a path is read if either contains the other."""

    only: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    last_scalar: bool = False  # of a list of plain values the last one instead of all
    flatten_single: bool = True  # a list of objects that never has two is part of its parent

    def reads(self, path: str) -> bool:
        if self.only and not any(k in path or path in k for k in self.only):
            return False
        return not any(k in path for k in self.exclude)


def _is_list(t: DataType) -> bool:
    return isinstance(t, ArrayType) and isinstance(t.elementType, StructType)


def _list_paths(schema: StructType, o: Options, at: str = "/") -> list[str]:
    out = []
    for f in schema:
        path, t = f"{at}{f.name}/", f.dataType
        if not o.reads(path):
            continue
        if _is_list(t):
            out += [path, *_list_paths(t.elementType, o, path)]
        elif isinstance(t, StructType):
            out += _list_paths(t, o, path)
    return out


def _field(name: str):
    return lambda x: x[name]


def _nested(root: list[Column], schema: StructType, steps: list[str]) -> Column:
    """An array of all values at a path, lists on the way flattened."""
    values, t = None, schema
    for name in steps:
        f = t[name]
        if values is None:
            values = F.array(F.col(f"`{name}`"))
        else:
            values = F.transform(values, _field(name))
        t = f.dataType
        if _is_list(t) and name is not steps[-1]:
            values, t = F.flatten(F.filter(values, lambda x: x.isNotNull())), t.elementType
        elif _is_list(t):
            t = t.elementType
    return values


def repeated_paths(docs: DataFrame, o: Options | None = None) -> set[str]:
    """Paths of lists that hold two objects or more in some document: one aggregate over all lists."""
    o = o or Options()
    paths = _list_paths(docs.schema, o)
    if not paths or not o.flatten_single:
        return set(paths)
    most = []
    for k, path in enumerate(paths):
        lists = _nested([], docs.schema, path.strip("/").split("/"))
        sizes = F.transform(F.filter(lists, lambda x: x.isNotNull()), lambda x: F.size(x))
        most.append(F.max(F.array_max(sizes)).alias(f"m{k}"))
    row = docs.agg(*most).first()
    return {path for k, path in enumerate(paths) if (row[k] or 0) > 1}


def shred(docs: DataFrame, doc: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Tables by path. Each has id, doc (the id of the document) and, but for '/', parent (the id of the row it belongs to).

    `doc` is the column with a document's id. Objects are flattened into the nearest list
    above under their whole path; ids of list rows are the parent's id and the place in the
    list, so they are the same in every run. Columns that are null everywhere are for `drop_empty`.
    """
    o = options or Options()
    repeated = repeated_paths(docs, o)
    tables: dict[str, DataFrame] = {}

    def walk(frame: DataFrame, value, schema: StructType, path: str, keys: list[str], owner: str) -> None:
        plain, lists = [], []

        def flat(t: StructType, get, at: str) -> None:
            for f in t:
                p, kind = f"{at}{f.name}/", f.dataType
                if not o.reads(p) or (at == "/" and f.name == doc and path == "/"):
                    continue
                c = get(f.name)
                if isinstance(kind, StructType):
                    flat(kind, lambda n, c=c: c[n], p)
                elif _is_list(kind) and p in repeated:
                    lists.append((p, c, kind.elementType))
                elif _is_list(kind):
                    flat(kind.elementType, lambda n, c=c: F.get(c, F.lit(0))[n], p)
                elif isinstance(kind, ArrayType) and o.last_scalar:
                    plain.append(F.element_at(c, -1).alias(p))
                else:
                    plain.append(c.alias(p))

        flat(schema, value, path)
        tables[path] = frame.select(*keys, *plain)
        for p, c, kind in lists:
            rows = frame.select(F.col("doc"), F.col("id").alias("parent"), F.posexplode(c).alias("__k", "__v"))
            rows = rows.withColumn("id", F.concat_ws(".", "parent", F.lit(p.strip("/").split("/")[-1]), F.col("__k").cast("string")))
            walk(rows, lambda n: F.col("__v")[n], kind, p, ["id", "doc", "parent"], p)

    root = docs.withColumns({"id": docs[doc].cast("string"), "doc": docs[doc].cast("string")}) if doc not in ("id", "doc") else docs.withColumns({"doc": F.col(doc).cast("string"), "id": F.col(doc).cast("string")})
    walk(root, lambda n: F.col(f"`{n}`"), docs.schema, "/", ["id", "doc"], "/")
    return tables


def drop_empty(table: DataFrame) -> DataFrame:
    """The table without the columns that have no value at all."""
    if not table.columns:
        return table
    row = table.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(table.columns)]).first()
    return table.select(*[F.col(f"`{c}`") for k, c in enumerate(table.columns) if row[k]])


def path_norm(path: str) -> str:
    """A path's letters, everything else as one underscore."""
    return re.sub(r"[\W\d_]+", "_", path).strip("_")


def aliases(paths: list[str], most: int = 3, norm=path_norm, taken: tuple[str, ...] = ("id", "doc", "parent")) -> dict[str, str]:
    """A name for each path: the shortest of its last one to `most` steps that no path before it has; a number is added to what still clashes."""
    out, used = {}, set(taken)
    for path in sorted(paths, key=lambda p: (p.count("/"), p)):
        steps = [s for s in path.strip("/").split("/") if s]
        tries = [norm("/".join(steps[-k:])) for k in range(1, min(most, len(steps)) + 1)] or ["root"]
        name = next((t for t in tries if t and t not in used), None)
        k = 2
        while name is None:
            name = f"{tries[-1]}_{k}" if f"{tries[-1]}_{k}" not in used else None
            k += 1
        used.add(name)
        out[path] = name
    return out


def ingest(docs: DataFrame, doc: str, options: Options | None = None) -> dict[str, DataFrame]:
    """shred() with short names for tables and columns."""
    tables = shred(docs, doc, options)
    names = aliases(list(tables), taken=())
    out = {}
    for path, table in tables.items():
        columns = aliases([c for c in table.columns if c not in ("id", "doc", "parent")])
        out[names[path]] = table.withColumnsRenamed(columns)
    return out

"""Results and annotations as files."""

from __future__ import annotations

import os

import yaml
from pyspark.sql import DataFrame, SparkSession


def memoised(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The table at path; made and written if it isn't there or refresh is set."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    done = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if refresh or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_bindings(path: str) -> dict[str, dict[str, list[str]]]:
    """{table: {column: [tag, ...]}} of a YAML file in which a column has a tag, a list of tags or nothing."""
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    return {t: {c: [v] if isinstance(v, str) else list(v or []) for c, v in (columns or {}).items()} for t, columns in found.items()}


def write_blank_bindings(tables: dict[str, DataFrame], path: str) -> None:
    """A YAML file that names every table and column, for tags to be filled in."""
    blank = {name: {c: None for c in t.columns if c not in ("id", "doc", "parent")} for name, t in tables.items()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(blank, f, allow_unicode=True, sort_keys=True)


def ingested(docs: DataFrame, doc: str, folder: str, bindings: str, options=None) -> dict[str, DataFrame]:
    """The tables of nested documents: shredded by repeated path, with short names and without empty columns, each written under folder once
    and then read, and a blank file of bindings for them if there is none."""
    from .shred import drop_empty, ingest

    spark = docs.sparkSession
    tables = {name: memoised(spark, f"{folder.rstrip('/')}/{name}", lambda t=t: drop_empty(t)) for name, t in ingest(docs, doc, options).items()}
    if not os.path.exists(bindings):
        write_blank_bindings(tables, bindings)
    return tables


def latex_table(table: DataFrame, decimals: int = 3, most: int = 1000) -> str:
    """A small table as LaTeX; raises if it has more than `most` rows."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    marks = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else "".join(marks.get(c, c) for c in str(v))
    numeric = [t in ("double", "float", "int", "bigint") for _, t in table.dtypes]
    lines = [rf"\begin{{tabular}}{{{''.join('r' if n else 'l' for n in numeric)}}}", r"\toprule", " & ".join(map(show, table.columns)) + r" \\", r"\midrule"]
    lines += [" & ".join(map(show, r)) + r" \\" for r in rows]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"]) + "\n"

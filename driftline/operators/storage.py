"""A source's tables and their semantic tags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EAV = "repo string, frame string, col string, doc string, id string, value string, assignement string"


@dataclass
class Storage:
    """Tables with columns doc and id, and bindings {table: {column: [tag, ...]}}."""

    name: str
    tables: dict[str, DataFrame]
    bindings: dict[str, dict[str, list[str]]]

    def docs(self) -> DataFrame:
        """Distinct documents over all tables."""
        return reduce(DataFrame.unionByName, [t.select(F.col("doc").cast("string")) for t in self.tables.values()]).distinct()

    def of_docs(self, docs: DataFrame) -> dict[str, DataFrame]:
        """The tables' rows of the given documents."""
        return {k: t.join(docs.select("doc").distinct(), "doc", "left_semi") for k, t in self.tables.items()}

    def melt(self, tag: str) -> DataFrame:
        """Every value of every column that has the tag, one a row; nulls are left out. A tag without columns gives an empty table."""
        found = []
        for frame, columns in self.bindings.items():
            tagged = [c for c, tags in columns.items() if tag in (tags or [])]
            if tagged and frame in self.tables:
                found.append(unpivoted(self.tables[frame], tagged, self.name, frame))
        if not found:
            any_table = next(iter(self.tables.values()))
            return any_table.sparkSession.createDataFrame([], EAV)
        return reduce(DataFrame.unionByName, found).withColumn("assignement", F.lit(tag))

    def melt_all(self, tags: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.melt(t) for t in tags])


def unpivoted(table: DataFrame, columns: list[str], repo: str, frame: str) -> DataFrame:
    """(repo, frame, col, doc, id, value) of the columns; a list gives a row for each element."""
    kinds = dict(table.dtypes)
    plain = [c for c in columns if not kinds[c].startswith("array")]
    keys = [F.col("doc").cast("string").alias("doc"), F.col("id").cast("string").alias("id")]
    parts = []
    if plain:
        wide = table.select(*keys, *[F.col(f"`{c}`").cast("string").alias(f"v:{c}") for c in plain])
        parts.append(wide.unpivot(["doc", "id"], [f"v:{c}" for c in plain], "col", "value").withColumn("col", F.substring("col", 3, 1 << 20)))
    for c in columns:
        if c not in plain:
            parts.append(table.select(*keys, F.lit(c).alias("col"), F.explode(F.col(f"`{c}`").cast("array<string>")).alias("value")))
    out = reduce(DataFrame.unionByName, parts).where("value is not null")
    return out.select(F.lit(repo).alias("repo"), F.lit(frame).alias("frame"), "col", "doc", "id", "value")

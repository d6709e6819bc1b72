"""Facts of documents: codes, events, classifications and places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import mixed_date, parts
from ..functions.geo import vincenty
from ..session import checked_small, written

EVENT_ORDER = ["exhibition", "priority", "regional", "fill", "application", "nogrant", "grant", "decision", "publication"]


def codes(eav: DataFrame, country: str | None = None, countries: DataFrame | None = None) -> DataFrame:
    """(doc, country, number): of application codes, country being given, by (doc, value), or the code's own prefix."""
    one = text.application_code(F.col("value"))
    rows = eav.select("doc", one.alias("c")).where("c.number is not null")
    if countries is not None:
        known = countries.groupBy("doc").agg(F.min("value").alias("country"))
        return rows.join(known, "doc", "left").select("doc", "country", F.col("c.number").alias("number")).distinct()
    of = F.lit(country) if country else F.col("c.prefix")
    return rows.select("doc", of.alias("country"), F.col("c.number").alias("number")).distinct()


def events(eav: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """(doc, event, date, year, month, day, delay): dates of tags such as 'date-grant'; delay is days since the first of all.

    What is no date is left out, and equal events count once.
    """
    rows = eav.select("doc", F.split_part("assignement", F.lit("-"), F.lit(2)).alias("event"), mixed_date(F.col("value")).alias("date"))
    rows = rows.where("date is not null").distinct()
    first = rows.agg(F.min("date").alias("__first"))
    out = rows.crossJoin(F.broadcast(first)).withColumns(parts(F.col("date")))
    out = out.withColumn("delay", F.datediff("date", "__first")).drop("__first")
    return out.join(code, "doc", "left") if code is not None else out


def classes(texts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(doc, classification, section, class): of symbols (doc, id, assignement, value), and of single fields tagged 'IPCR-section' and so on."""
    c = text.classification(F.col("value"))
    rows = texts.select("doc", F.col("assignement").alias("classification"), c.alias("c")).select("doc", "classification", "c.section", "c.class")
    if fields is not None:
        part = lambda k: F.min(F.when(F.split_part("assignement", F.lit("-"), F.lit(2)) == k, F.col("value"))).alias(k)
        kind = F.split_part("assignement", F.lit("-"), F.lit(1)).alias("classification")
        rows = rows.unionByName(fields.groupBy("doc", "id", kind).agg(part("section"), part("class")).drop("id"))
    return rows.where("section is not null")


def places(eav: DataFrame, gazetteer: DataFrame, kind: str = "miasto") -> DataFrame:
    """(doc, city, lat, lon, loceval): towns that a document names, where a name means several the set of places nearest to each other."""
    named = eav.select("doc", F.explode(text.city_names(F.col("value"))).alias("city")).distinct()
    towns = gazetteer.where(F.col("type") == kind).select(text.strnorm(F.col("city"), True, True).alias("city"), "lat", "lon").distinct()
    return closest(named.join(towns, "city").dropna(subset=["lat", "lon"]))


def _apart(docs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each document the distances between all its places: one calculation for many documents."""
    flat = [np.concatenate(points) for points in docs]
    pairs = [np.divmod(np.arange(len(f) ** 2), len(f)) for f in flat]
    ends = [np.concatenate([f[side[k]] for f, side in zip(flat, pairs, strict=True)]) for k in (0, 1)]
    km = vincenty(ends[0][:, 0], ends[0][:, 1], ends[1][:, 0], ends[1][:, 1])
    cuts = np.cumsum([len(f) ** 2 for f in flat])[:-1]
    return [x.reshape(len(f), -1) for x, f in zip(np.split(km, cuts), flat, strict=True)]


def _choose(points: list[np.ndarray], apart: np.ndarray | None = None) -> list[int]:
    """A place for each name so that the sum of all distances is least; of equals the combination that is last in order.

    Names are settled one after the other. What is open can't cost less than the nearest places to those that are settled, and the
    least distances between open names; a branch that can't reach the best known sum is left. So the result is that of trying
    all combinations, at any number of them.
    """
    apart = _apart([points])[0] if apart is None else apart
    start = np.cumsum([0, *map(len, points)])
    both = apart + apart.T
    n = len(points)
    options = [np.arange(start[k], start[k + 1]) for k in range(n)]
    between = np.array([[both[np.ix_(options[i], options[j])].min() if i != j else 0.0 for j in range(n)] for i in range(n)])
    open_cost = [np.triu(between[k:, k:]).sum() for k in range(n + 1)]
    total = lambda pick: apart[np.ix_(pick, pick)].sum()

    # a good sum to begin with: one place is bettered at a time
    best = [o[0] for o in options]
    for _ in range(20):
        before = list(best)
        for k, o in enumerate(options):
            best[k] = min(o, key=lambda x, k=k: total([*best[:k], x, *best[k + 1 :]]))
        if best == before:
            break
    least = total(best)
    todo = [([], 0.0, np.zeros(len(apart)))]  # settled places, their sum, and each place's distances to them
    while todo:
        pick, cost, near = todo.pop()
        k = len(pick)
        if k == n:
            t = total(pick)
            if t < least or t == least and pick > best:
                best, least = pick, t
            continue
        for o in options[k]:
            so_far, nearer = cost + near[o], near + both[o]
            bound = so_far + sum(nearer[x].min() for x in options[k + 1 :]) + open_cost[k + 1]
            if bound <= least * (1 + 1e-9) + 1e-9:
                todo.append(([*pick, o], so_far, nearer))
    return [int(p - s) for p, s in zip(best, start[:-1], strict=True)]


def closest(named: DataFrame) -> DataFrame:
    """(doc, city, lat, lon, loceval) of (doc, city, lat, lon) with one place for each name of a document.

    loceval is 'unique' where there was only one, 'proximity' where the others decided, and
    'ambiguous' for a single name with several places, of which the least is taken. Documents that name the same towns are one choice.
    """
    # rows of a document meet once, and both groupings keep them there
    sized = named.repartition("doc").groupBy("doc", "city").agg(F.array_sort(F.collect_set(F.struct("lat", "lon"))).alias("at"))
    by_doc = sized.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("city", "at"))).alias("towns"), F.max(F.size("at")).alias("most"))
    plain = by_doc.where("most = 1 or size(towns) = 1")
    kind = F.when(F.size("t.at") == 1, "unique").otherwise("ambiguous")
    easy = plain.select("doc", F.explode("towns").alias("t")).select("doc", "t.city", F.col("t.at")[0]["lat"].alias("lat"), F.col("t.at")[0]["lon"].alias("lon"), kind.alias("loceval"))

    def choose(batches):
        for batch in batches:
            out = []
            listed = [[np.array([[p["lat"], p["lon"]] for p in t["at"]]) for t in towns] for towns in batch["towns"]]
            tables = _apart(listed) if listed else []
            for h1, h2, towns, points, apart in zip(batch["__h1"], batch["__h2"], batch["towns"], listed, tables, strict=True):
                for n, p, k in zip([t["city"] for t in towns], points, _choose(points, apart), strict=True):
                    out.append((h1, h2, n, float(p[k][0]), float(p[k][1]), "unique" if len(p) == 1 else "proximity"))
            yield pd.DataFrame(out, columns=["__h1", "__h2", "city", "lat", "lon", "loceval"])

    key = {f"__h{k}": F.xxhash64(F.lit(k), "towns") for k in (1, 2)}
    hard = by_doc.where("most > 1 and size(towns) > 1").select("doc", "towns").withColumns(key)
    n = 4 * named.sparkSession.sparkContext.defaultParallelism
    sets = hard.select(*key, "towns").distinct().repartition(n)
    chosen = checked_small(written(sets.mapInPandas(choose, "__h1 long, __h2 long, city string, lat double, lon double, loceval string"), "chosen"))
    return easy.unionByName(hard.select("doc", *key).join(chosen, list(key)).select("doc", "city", "lat", "lon", "loceval"))


def distances(towns: DataFrame, kind: str | None = "miasto") -> DataFrame:
    """(lat, lon, latY, lonY, distance): kilometres on the ellipsoid between all pairs of towns, a table of places and not of documents."""
    from ..functions.geo import geodesic

    rows = towns.where(F.col("type") == kind) if kind else towns
    a = rows.select("lat", "lon").dropna().distinct()
    b = a.withColumnsRenamed({"lat": "latY", "lon": "lonY"})
    pairs = a.crossJoin(checked_small(b))
    return pairs.withColumn("distance", geodesic(F.col("lat"), F.col("lon"), F.col("latY"), F.col("lonY")))

"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's budget is met by the documents below a
threshold, which histograms of size by hash bucket find: the bucket where the running sum
passes the budget is the only one that is split further, so nothing is sorted and larger
budgets take supersets of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix has 3/2 of all words
CAP = 2  # times its source's size
HASH_BITS, STEP_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the key's string form; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(skey, source_size, target) per source.

    Sources in code point order, null last, take the weights in turn. The budget is shared
    by weight; a source stops at cap times its size and what it leaves is shared again:
    the level at which all uncapped sources stand is found from running sums in the order
    in which the caps are reached. Those windows see one row per source, in one task: meant for up to some millions of sources.
    """
    dec = "decimal(38,0)"
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights)) + 1)
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("w", w.cast("long")).withColumn("c", F.col("source_size") * cap)
    # all weights divide their product, so c * product / w is exact
    product = 1
    for x in weights:
        product *= x
    per = per.withColumn("q", (F.col("c").cast(dec) * product / F.col("w")).cast(dec))
    order = Window.orderBy("q", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("q", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "c_before": F.coalesce(F.sum(F.col("c").cast(dec)).over(order), F.lit(0).cast(dec)),
            "w_before": F.coalesce(F.sum("w").over(order), F.lit(0)),
            "w_all": F.sum("w").over(whole),
            "s_all": F.sum(F.col("source_size").cast(dec)).over(whole),
        }
    )
    num = F.col("s_all") * share[0] - F.col("c_before") * share[1]
    den = (F.col("w_all") - F.col("w_before")) * share[1]
    per = per.withColumn("num", num.cast(dec)).withColumn("den", den.cast("long"))
    free = F.col("num") * product <= F.col("den").cast(dec) * F.col("q")
    per = per.withColumn("pivot", F.min(F.when(free, F.struct("q", "rank", "num", "den"))).over(whole))
    capped = F.struct("q", "rank") < F.struct("pivot.q", "pivot.rank")
    level = (F.col("w") * F.col("pivot.num")).cast("double") / F.col("pivot.den").cast("double")
    target = F.when(F.col("pivot").isNull() | capped, F.col("c").cast("double")).otherwise(level)
    return per.select("skey", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, step: int = STEP_BITS) -> DataFrame:
    """(skey, base, threshold): every document is taken base times, and once more if its hash is below threshold.

    step bits of the hash are decided in a pass; the boundary document is in or out,
    whichever is nearer, along with any that have its very hash.
    """
    sources = targets.count()
    state = written(
        targets.select(
            "skey",
            F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0).cast("long").alias("base"),
            (F.col("target") - F.when(F.col("target") >= F.col("source_size"), F.col("source_size")).otherwise(0)).alias("budget"),
            F.lit(0).cast("long").alias("prefix"),
            F.lit(0).cast("long").alias("below"),
            F.lit(0).cast("long").alias("at"),
            F.lit(False).alias("all"),
        ),
        "budgets",
        sources,
    )
    for shift in range(HASH_BITS - step, -1, -step):
        keys = state.where("not `all`").select("skey", F.col("prefix").alias("p"))
        inside = sizes.where("size > 0").join(keys, "skey")
        hist = (
            inside.where(F.shiftright("h", shift + step) == F.col("p"))
            .groupBy("skey", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        run = Window.partitionBy("skey").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        hist = hist.join(state.select("skey", F.col("budget").alias("g"), F.col("below").alias("b")), "skey")
        first = hist.where(F.col("b") + F.col("upto") > F.col("g")).groupBy("skey").agg(F.min(F.struct("bucket", "upto", "n")).alias("f"))
        state = written(
            state.join(first, "skey", "left").select(
                "skey",
                "base",
                "budget",
                F.coalesce("f.bucket", "prefix").alias("prefix"),
                F.coalesce(F.col("below") + F.col("f.upto") - F.col("f.n"), F.col("below")).alias("below"),
                F.coalesce("f.n", "at").alias("at"),
                (F.col("all") | F.col("f").isNull()).alias("all"),
            ),
            "budgets",
            sources,
        )
    over, under = F.col("below") + F.col("at") - F.col("budget"), F.col("budget") - F.col("below")
    cut = F.col("prefix") + F.when(over < under, 1).otherwise(0)
    return state.select("skey", "base", F.when(F.col("all"), F.lit(1 << HASH_BITS)).otherwise(cut).cast("long").alias("threshold"))


def _parts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    source = docs[source_col]
    return {
        "skey": F.coalesce(F.concat(F.lit("="), source), F.lit("")),
        "size": size_of(docs[text_col]),
        "h": hash_of(docs[id_col]),
    }


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sizes by document, and per source its target and thresholds."""
    parts = _parts(docs, id_col, text_col, source_col)
    sizes = written(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), *[c.alias(k) for k, c in parts.items()]),
        "sizes",
    )
    targets = written(source_targets(sizes), "targets")
    return sizes, written(targets.join(thresholds(sizes, targets), "skey"), "cuts", targets.count())


def _copies() -> Column:
    return (F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    Null texts and texts without words have size 0 and take nothing. Rows with the same id
    share a fate. Null sources are one source, the last. Other columns are ignored.
    """
    sizes, cuts = _plan(docs, id_col, text_col, source_col)
    out = sizes.join(cuts, "skey").withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a document appears as many times as it is taken, all columns as they were.

    Documents without words weigh nothing and stay once. Texts don't shuffle unless there
    are too many sources to broadcast.
    """
    _, cuts = _plan(docs, id_col, text_col, source_col)
    parts = _parts(docs, id_col, text_col, source_col)
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in parts.items()]).join(cuts, "skey")
    times = F.when(F.col("size") > 0, _copies()).otherwise(1)
    return rows.withColumn("k", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")

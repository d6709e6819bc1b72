"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, those into phrases of phrases, and so on.
Runs of one symbol become one. Deterministic coin tossing then gives every symbol a label
below six from a few symbols before it, neighbours get different labels, and a phrase starts
at each local maximum. Where phrases start and what they are named depends on nearby symbols
only, so equal substrings have the same phrases inside them at whatever offset they lie.
The fingerprint is a sketch of the names at the upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import modest_batches, written

FROM_LEVEL = 2  # the first level whose names count: phrases of some ten characters
BINS = 128
EMPTY = 0xFFFF
BATCH_CHARS = 1 << 20  # code points that are parsed together; a longer text is parsed alone
BUCKET_ROWS = 20_000

_ONE = np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss_table(size: int) -> np.ndarray:
    """Labels for (label, label before) below size: twice the lowest bit that differs, plus that bit."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    d = np.where(a == b, 1, a ^ b)
    low = np.bitwise_count((d & -d) - 1).astype(np.int64)
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


_TOSSES = [(size, _toss_table(size)) for size in (128, 14, 8)]  # 128 labels become 14, then 8, then 6


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours; first marks the start of each text."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    d = x ^ before
    low = np.bitwise_count((d & (~d + _ONE)) - _ONE)
    label = (low << 1) | ((x >> low) & _ONE).astype(np.uint8)
    for size, table in _TOSSES:
        near = np.empty_like(label)
        near[1:] = label[:-1]
        near[first] = np.where(label[first] == 0, 1, 0)
        label = table[label.astype(np.int64) * size + near]
    return label


def _runs(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a symbol as one symbol that is named after it and its count."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    if len(at) == len(x):
        return x, doc
    length = np.diff(at, append=len(x)).astype(np.uint64)
    x, doc = x[at], doc[at]
    many = length > 1
    x[many] = _mix(x[many] + length[many] * _POWERS[3])
    return x, doc


def _next_level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of phrases and the texts they belong to."""
    x, doc = _runs(x, doc)
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    label = _labels(x, starts)
    peak = first.copy()
    rise = label[1:] > label[:-1]
    peak[1:-1] |= rise[:-1] & ~rise[1:]
    ends = np.append(starts[1:], len(x)) - 1  # what follows in another text has no say
    peak[ends] = first[ends]
    at = np.flatnonzero(peak)
    place = np.arange(len(x)) - np.repeat(at, np.diff(at, append=len(x)))
    return _mix(np.add.reduceat(_mix(x) * _POWERS[place & 63], at)), doc[at]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit numbers per text: the least name of each bin, EMPTY where there is none."""
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if lengths.sum():
        x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        x = _mix(x + _POWERS[2])
        doc = np.repeat(np.arange(len(texts)), lengths)
        level = 0
        while len(x):  # a text leaves when it is one phrase; each level at least halves the others
            level += 1
            x, doc = _next_level(x, doc)
            more = np.ones(len(x), bool)
            more[1:] = doc[1:] != doc[:-1]
            single = more & np.append(more[1:], True)  # a text that is one phrase has its last name, which counts at any level
            at = slice(None) if level >= FROM_LEVEL else single
            name = _mix(x[at] + np.uint64(level))
            np.minimum.at(least, doc[at] * BINS + (name & np.uint64(BINS - 1)).astype(np.int64), name >> np.uint64(7))
            x, doc = x[~single], doc[~single]
    out = np.minimum(_mix(least) >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16)
    out[least == np.iinfo(np.uint64).max] = EMPTY
    return out.reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of names that two rows of sketches have in common (Dice), 1 for two empty ones."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    jaccard = np.where(filled == 0, 1.0, same / np.maximum(filled, 1))
    return 2 * jaccard / (1 + jaccard)


def as_bytes(sketch: np.ndarray) -> list[bytes]:
    """Two bytes for each bin, the higher first."""
    return [row.tobytes() for row in sketch.astype(">u2")]


def all_sketches(texts: list[str]) -> np.ndarray:
    """sketches() of groups of texts of at most BATCH_CHARS code points."""
    out, group, chars = [], [], 0
    for t in texts:
        if group and chars + len(t) > BATCH_CHARS:
            out.append(sketches(group))
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        out.append(sketches(group))
    return np.concatenate(out) if out else np.empty((0, BINS), np.uint16)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROW, FIRST, LAST = range(3)  # a result, and the first and last document of a partition
FOUND = "kind int, part int, doc_id long, n_chars long, edited binary, own binary, other binary, near_edited double, near_next double, t string"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _ids(ids: list) -> pd.api.extensions.ExtensionArray:
    return pd.array([int(i) if i is not None and i == i else None for i in ids], "Int64")


def _compared(ids: list, texts: list[str], following: list[str], part: int = 0) -> pd.DataFrame:
    """Results of texts, each with the one that follows it."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    chain = texts[1:] == following[:-1]  # so all but the last one's next have a sketch already
    both = all_sketches([*texts, *(following[-1:] if chain else following)])
    own, after = both[: len(texts)], both[1:] if chain else both[len(texts) :]
    other = all_sketches(changed)
    out = pd.DataFrame(
        {
            "doc_id": _ids(ids),
            "n_chars": [len(t) for t in texts],
            "edited": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed],
            "own": as_bytes(own),
            "other": as_bytes(other),
            "near_edited": likeness(own, other),
            "near_next": likeness(own, after),
        }
    )
    return out.assign(kind=ROW, part=part, t=None)[COLUMNS]


def _partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of all documents of a sorted partition but the last, and its first and last documents."""
    ids, texts, chars, part = [], [], 0, None
    for batch in batches:
        if part is None and len(batch):
            part = int(batch["part"].iloc[0])
            yield _border(FIRST, part, batch["id"].iloc[0], batch["t"].iloc[0])
        for i, t in zip(batch["id"], batch["t"], strict=True):
            ids.append(i)
            texts.append(t)
            chars += len(t)
            if len(texts) > 1 and (chars > BATCH_CHARS or len(texts) >= 500):
                yield _compared(ids[:-1], texts[:-1], texts[1:], part)
                ids, texts, chars = ids[-1:], texts[-1:], len(t)
    if len(texts) > 1:
        yield _compared(ids[:-1], texts[:-1], texts[1:], part)
    if texts:
        yield _border(LAST, part, ids[-1], texts[-1])


def _border(kind: int, part: int, i, t: str) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": _ids([i]), "t": [t]})
    return out.assign(kind=kind, part=part, n_chars=0, edited=None, own=None, other=None, near_edited=0.0, near_next=0.0)[COLUMNS]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, t, after in zip(batch["id"], batch["t"], batch["after"], strict=True):
            yield _compared([i], [t], [after])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next id, after the last the first; a single one is its
    own next. Null ids come first; rows of one id go by their text's hash. Null text is
    empty; an empty text has no names, and is like another empty one (1) and unlike others
    (0). Texts shuffle once, to ranges of (id, hash, row), so a range is split wherever ids repeat; each range's last document
    meets the first of the next range in a second step over two documents for each range.
    Other columns are ignored. Memory holds BATCH_CHARS characters, or one text that is longer. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.count()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    modest_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    plain = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("t"), F.col("tie")]
    dealt = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.col("id").cast("string"), "t", F.spark_partition_id().alias("part"))
    found = written(dealt.mapInPandas(_partition, FOUND), "phrases")
    firsts, lasts = (found.where(F.col("kind") == k).select("part", F.col("doc_id").cast("string").alias("id"), "t") for k in (FIRST, LAST))
    # a number for each range, of which there is one for BUCKET_ROWS documents
    by_part = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next"))
    pairs = lasts.join(following, "part").join(firsts.select(F.col("part").alias("next"), F.col("t").alias("after")), "next")
    found = found.where(F.col("kind") == ROW).drop("t").unionByName(pairs.select("id", "t", "after").mapInPandas(_pairs, FOUND).drop("t"))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", "n_chars", text("edited").alias("edited_sha256"), text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"), "near_edited", "near_next"
    )

"""Substring dedup: lines that occur more than once are kept where they come first.

Lines are normalised and hashed, digests grouped over all documents, and every later occurrence is a span of the
original text to cut, whole. A passage of short lines, or inside lines that are otherwise different, is found the same way: a long
line is also cut at words that its content picks, and short lines and parts that follow one another and all occurred before are spans if
they have as many words together as a line must have. Only digests and offsets shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import modest_batches, written
from .exact_dedup import _cells, bitmap_of, filter_bits, in_bitmap

SEPARATOR = "\n"
MIN_WORDS = 20  # shorter lines and passages repeat by chance or by design, and stay
LONG = 24  # words of a line that isn't cut into parts as well
REACH = 6  # words to either side that a break must come before in hash order
HOT_GROUPS = 1024  # at most so many digests are joined by broadcast
BATCH_UNITS = 20_000
KNOWN_WORDS = 200_000  # hashes that a task remembers

_WHITE = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")  # all but what is a single space already
_LAST = np.iinfo(np.int64).max


def normal(unit: str) -> str:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return _WHITE.sub(" ", unit.lower()).strip(" ")


class WordHashes(dict):
    """60 bits of the MD5 of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
        return found


def breaks(lines: list[list[str]], hashes: WordHashes) -> list[list[int]]:
    """For each line's words the places that units start at: words whose hash is less than those of the REACH
    words before and no more than those of the REACH words after, as far as the line goes."""
    pad = [_LAST] * REACH
    row = list(pad)
    for words in lines:
        row += map(hashes.__getitem__, words)
        row += pad
    h = np.array(row, np.int64)
    n = len(h) - 2 * REACH
    before = after = np.full(n, _LAST)
    for k in range(1, REACH + 1):
        before = np.minimum(before, h[REACH - k : REACH - k + n])
        after = np.minimum(after, h[REACH + k : REACH + k + n])
    own = h[REACH : REACH + n]
    picked = np.flatnonzero((own < before) & (own <= after))
    out, at = [], 0
    for words in lines:
        lo, hi = np.searchsorted(picked, [at + 1, at + len(words)])
        out.append((picked[lo:hi] - at).tolist())
        at += len(words) + REACH
    return out


def units(text: str | None, separator: str = SEPARATOR, min_words: int = MIN_WORDS, hashes: WordHashes | None = None) -> Iterator[tuple]:
    """(start of the line, part, start, end, words, whole, digest) of units; offsets are code points, separators are outside.

    Parts are lines and what long lines are cut into, if they aren't blank, numbered through the text. A line that is cut is a unit
    as well, with part -1, if it has min_words words. `whole` marks lines of min_words words.
    Words for cutting are what stands between single spaces, those of a unit what stands between white space.
    """
    hashes = WordHashes() if hashes is None else hashes
    at, spans, long = 0, [], []
    for line in (text or "").split(separator):
        if line.count(" ") >= LONG:
            spans.append((at, line, len(long)))
            long.append(line.lower().split(" "))
        else:
            spans.append((at, line, None))
        at += len(line) + len(separator)
    starts = breaks(long, hashes) if long else []
    part = 0

    def digested(piece: str) -> tuple[int, bytes]:
        clean = normal(piece)
        return (clean.count(" ") + 1 if clean else 0), xxhash.xxh3_128_digest(clean.encode("utf-8", "surrogatepass"))

    for at, line, k in spans:
        words, digest = digested(line)
        if not words:
            continue
        if k is None or not starts[k]:
            yield at, part, at, at + len(line), words, words >= min_words, digest
            part += 1
            continue
        if words >= min_words:
            yield at, -1, at, at + len(line), words, True, digest
        place = np.cumsum([0, *(len(w) + 1 for w in line.split(" "))])
        cuts = [0, *place[starts[k]].tolist(), len(line) + 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words, digest = digested(line[a : b - 1])
            if words:
                yield at, part, at + a, at + b - 1, words, False, digest
                part += 1


def unit_table(docs: DataFrame, id_col: str, text_col: str, separator: str, min_words: int) -> DataFrame:
    """(doc_id, copy, line, part, start, end, words, whole, digest) of all units; copy is a hash of the text, for rows of one id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "copy", "line", "part", "start", "end", "words", "whole", "digest"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            return pd.DataFrame(columns | {"doc_id": pd.array(columns["doc_id"], "Int64")})

        rows, hashes = [], WordHashes()
        for batch in batches:
            for doc, text in zip(batch["d"], batch["t"], strict=True):
                doc = int(doc) if doc else None
                copy = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1
                for unit in units(text, separator, min_words, hashes):
                    rows.append((doc, copy, *unit))
                    if len(rows) >= BATCH_UNITS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    modest_batches(docs.sparkSession)
    plain = docs.select(docs[id_col].cast("long").cast("string").alias("d"), docs[text_col].alias("t"))
    return plain.mapInPandas(run, "doc_id long, copy long, line long, part int, start long, end long, words int, whole boolean, digest binary")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = SEPARATOR, min_words: int = MIN_WORDS
) -> DataFrame:
    """Spans to remove: doc_id, start, end, keep_doc_id, keep_start, occurrences, whole.

    Of equal lines of min_words words or more the one of the least (doc_id, start) stays, null ids last; every other
    one is a row with `whole`, within one document too. Of what else occurred before, lines and parts of lines are rows
    if they have min_words words together with those next to them that did so too. occurrences is of the unit's text, as
    line or part. Rows of one id are one document: a unit that is at the
    same place in each is the same unit, though it counts as two occurrences. Null and empty texts have
    no units; other columns are ignored.
    """
    found = written(unit_table(docs, id_col, text_col, separator, min_words), "units")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("start").alias("start"))
    groups = found.groupBy("digest").agg(F.count("*").alias("occurrences"), F.min(first).alias("keep"))
    rows = found.count()
    groups = written(groups.where("occurrences > 1"), "repeated", rows)
    hot_from = max(1000, rows // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col("occurrences") >= hot_from)), groups.where(F.col("occurrences") < hot_from)
    # a Bloom bitmap of the repeated digests lets hardly any other unit shuffle
    bits = filter_bits(groups.count())
    blocks = bitmap_of(groups.select(_cells(F.col("digest"), bits, 1)[0].alias("cell")))
    asked = found.select(F.struct(*[c for c in found.columns if c != "digest"]).alias("row"), "digest")
    found = in_bitmap(asked, "digest", blocks, bits, 1).where("maybe").select("row.*", "digest")
    joined = found.join(hot, "digest").unionByName(found.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    stays = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.start") == F.col("start"))
    later = joined.where(~stays)
    # one exchange by text: what is at the same place is one unit; a run has consecutive numbers
    doc = ["doc_id", "copy"]
    once = later.withColumn("k", F.row_number().over(Window.partitionBy(*doc, "line", "part").orderBy("start"))).where("k = 1")
    once = once.withColumn("gone", F.max("whole").over(Window.partitionBy(*doc, "line")))
    once = once.withColumn("run", F.col("part") - F.row_number().over(Window.partitionBy(*doc, F.col("part") < 0).orderBy("part")))
    once = once.withColumn("together", F.sum(F.when(F.col("part") >= 0, F.col("words"))).over(Window.partitionBy(*doc, F.col("part") < 0, "run")))
    return once.where(F.col("whole") | (~F.col("gone") & (F.col("together") >= min_words))).select(
        "doc_id", "start", "end", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "occurrences", "whole"
    )


def cut(text: str | None, spans: list[tuple[int, int]], separator: str = SEPARATOR) -> str | None:
    """The text without the spans, each with the separator or space after it; a text that so ends in one loses that too."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = min(end + 1, len(text)) if text[end : end + 1] == " " else min(end + len(separator), len(text))
    out.append(text[at:])
    rest = "".join(out)
    if at < len(text) or text.endswith((separator, " ")):
        return rest
    return rest.removesuffix(separator).removesuffix(" ")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def remove_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans cut from their texts and two more columns last: removed (the spans, offsets of the
    original text) and original_chars, with underscores after names that docs has. A document without spans has an empty list; all its text may go.
    Rows of one id all lose that id's spans; a null id loses none.
    """
    by_doc = spans.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    by_doc = by_doc.agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        found = [[] if c is None else [(s["start"], s["end"]) for s in c] for c in cuts]
        return pd.Series([cut(t, c) for t, c in zip(texts, found, strict=True)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    rows = rows.join(by_doc, "__id", "left")
    kept = [F.col("row").getField(c).alias(c) if c != text_col else without("__text", "__spans").alias(c) for c in docs.columns]
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    removed = _free("removed", docs.columns)
    chars = _free("original_chars", [*docs.columns, removed])
    return rows.select(*kept, F.coalesce("__spans", none).alias(removed), F.length("__text").alias(chars))

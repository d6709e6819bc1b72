"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with labelled text. A text is
compressed with every dictionary, and the one that makes it smallest names the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import modest_batches, tidy_worker

UNDETERMINED = "und"
LEVEL = 9  # searches for matches longer than the fast levels do: short texts need that
DICTIONARY_BYTES = 128 << 10
SAMPLE_DOCS = 400  # labelled documents per language, give or take what hashes do
PIECE, PIECES = 320, 8  # characters that a dictionary takes of a text at once, and how often at most
MAX_LANGUAGES = 400  # the most frequent ones are told apart
HASHES = 1 << 40
CHUNK = 4096  # characters that are compressed at once, so that all of a text is judged by the dictionaries
NARROW = 0.02  # a margin below this is no decision

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's words in lower case, parted by single spaces."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learnt from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    sample_docs: int = SAMPLE_DOCS,
    size: int = DICTIONARY_BYTES,
    piece: int = PIECE,
    pieces: int = PIECES,
    most: int = MAX_LANGUAGES,
) -> dict[str, bytes]:
    """A dictionary of at most `size` bytes for each of the `most` most frequent languages.

    About sample_docs labelled documents of each are sampled, those whose hash is below the language's threshold; a
    language of no more has all of them, and copies of a text count once. Whole texts are cut into pieces, of which
    those of the least hashes are taken, at most `pieces` of a text. A dictionary has one piece of each text
    in the order of hashes, then a second one of each, until it is full. These bounds are all that is bounded: labels are counted over all rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return {}
    below = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(HASHES, sample_docs * HASHES // r["count"]))])
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(HASHES)) < F.element_at(below, F.col("lang"))).where("text is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")))
    cut = F.transform(starts, lambda k: F.substring(F.col("text"), k * piece + 1, F.lit(piece)))
    least = F.slice(F.array_sort(F.transform(cut, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, pieces)
    found: dict[str, dict[str, list[str]]] = {}
    for r in sorted(chosen.select("lang", F.xxhash64("text").alias("h"), least.alias("pieces")).distinct().collect()):
        found.setdefault(r.lang, []).append([letters(p.x) for p in r.pieces])
    out = {}
    for lang, texts in sorted(found.items()):
        taken = [t[k] for k in range(pieces) for t in texts if k < len(t) and t[k]]
        if taken:
            out[lang] = _filled(taken, size)
    return out


def _filled(taken: list[str], size: int) -> bytes:
    """The pieces one after the other, as many as there is room for."""
    out, room = [], size
    for t in taken:
        raw = t.encode()
        if len(raw) > room:
            break
        out.append(raw)
        room -= len(raw) + 1
    return b" ".join(out) if out else taken[0].encode()[:size]


class Classifier:
    """Language and margin of a text, by the size that each dictionary compresses it to."""

    def __init__(self, learned: dict[str, bytes]):
        import zstandard as z

        self.names, self.compressors = sorted(learned), []
        for name in self.names:
            content = z.ZstdCompressionDict(learned[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """lang_pred, score, rejected. The first name in order wins a tie, which is rejected."""
        words = letters(text or "")
        if not self.names or not any(map(str.isalpha, words)):
            return UNDETERMINED, 0.0, True
        chunks = [words[at : at + CHUNK].encode() for at in range(0, len(words), CHUNK)]
        sizes = [sum(len(c.compress(chunk)) for chunk in chunks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        next_best = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = 1 - sizes[best] / next_best
        return self.names[best], margin / (margin + NARROW), margin < NARROW


def predict(docs: DataFrame, learned: dict[str, bytes], text_col: str) -> DataFrame:
    """docs' columns in a struct `row` with lang_pred, score and rejected."""
    schema = "lang_pred string, score double, rejected boolean"
    modest_batches(docs.sparkSession)

    @F.pandas_udf(schema)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tidy_worker()
        classify = Classifier(learned)
        for texts in batches:
            yield pd.DataFrame([classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select(F.struct("*").alias("row"), judge(docs[text_col]).alias("it")).select("row", "it.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Labels of documents that aren't held out are the only ones read, and only to fill the
    dictionaries. Null texts and texts without a letter are `und` with score 0. score is
    0.5 where the margin is NARROW and grows with it; `rejected` marks narrower margins.
    Languages beyond the MAX_LANGUAGES most frequent are never predicted. Without any labelled text all are `und`. Rows that repeat are judged each; other
    columns are ignored. All of a text counts; memory holds one text and the dictionaries.
    """
    out = predict(docs, dictionaries(docs, id_col, text_col, lang_col), text_col)
    return out.select(
        F.col("row").getField(id_col).alias("doc_id"), held_out(F.col("row").getField(id_col)).alias("held_out"), "lang_pred", "score", "rejected"
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that the classifier rejects, all columns as they were."""
    learned = dictionaries(docs, id_col, text_col, lang_col)
    return predict(docs, learned, text_col).where("not rejected").select("row.*")

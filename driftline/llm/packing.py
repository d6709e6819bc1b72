"""Packing documents into windows of a fixed length by the sum-of-squares rule.

Each task packs the documents of its own partition as they come, so token ids are never
shuffled. A piece goes to the fill level that leaves the least sum of squared counts of
partly filled windows, kept in an array by level; if no window has room for it and no more may be open, the piece is
cut to fill one, by the same sum. At a task's end the emptiest windows are taken apart to fill the fuller
ones, and the rest is cut into windows of a power of two, so nothing is padded.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import KEPT, modest_batches, tidy_worker

WINDOW, END_ID = 2048, 1
OPEN_SHARE = 64  # pieces that must have been placed for each window that may be open, so that few are at the end
MAX_OPEN = 1024  # partly filled windows that a task holds: 8 MB of ids
CACHED_WORDS = 200_000  # per Python worker
STRIDE = 1 << 22  # characters that are tokenised at a time
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean"

# the tokenizer's own word pattern, for text below U+0250 where lower case and character classes agree
_SIMPLE = re.compile("[\x00-ɏ]*")
_BLANK = "\t-\r \x85\xa0"
_WORD = re.compile(f"[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\\w{_BLANK}]|_)+")
_TOUCHING = re.compile(r"[,.] (?<=(?:[^\w\s]|_)[,.] )")
_SPACE = re.compile(r"\s")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    What stands between blanks is numbered, and each different piece is looked up once for many texts: a word, a comma
    or full stop, or signs, digits and words that touch. The tokenizer sees each new word once while it is remembered.
    Two generations of at most `most` entries are kept: the older one goes when the newer is full.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.most, self.known, self.old = Tokenizer.from_file(path), most, {}, {}
        self.by_word = Tokenizer(self.tokenizer.model)  # for words that are split and in lower case already
        self.by_word.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[k for w, k in ids.items() if w.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, words: list[str]) -> None:
        """Encodes new words as one text; an id that ends a word shows where the next begins."""
        (found,) = self.by_word.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            self.known.update((w, self._whole(w)) for w in words)
            return
        raw = ids.tobytes()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _learn(self, pieces: list[str]) -> None:
        new = set(pieces) - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.old, self.known, new = self.known, {}, set(pieces)
        again = new & self.old.keys()
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new -= again
        words = {c for c in new if c.isalpha()}
        mixed = [(c, _WORD.findall(c)) for c in new - words]
        words.update(*[found for _, found in mixed])
        words -= self.known.keys()
        if words:
            self._encode_words(list(words))
        get = self.known.__getitem__
        self.known.update([(c, b"".join(map(get, found))) for c, found in mixed])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts = [(k, p) for k, t in enumerate(texts) for p in self._parts(t)]
        out: list[list[bytes]] = [[] for _ in texts]
        simple = self._looked_up([p for _, p in parts if isinstance(p, str)])
        for k, p in parts:
            out[k].append(next(simple) if isinstance(p, str) else p)
        return [b"".join(p) for p in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _looked_up(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts whose pieces are separated by single spaces."""
        if not parts:
            return iter(())
        split = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        numbered = split.values.dictionary_encode()
        pieces, which = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        self._learn(pieces)
        found = list(map(self.known.__getitem__, pieces))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        sizes = size[which]
        ends = np.cumsum(sizes)
        at = np.repeat(start[which] - (ends - sizes), sizes)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        cuts = np.append(0, ends)[split.offsets.to_numpy()].tolist()
        return (ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def _parts(self, text: str) -> list[str | bytes]:
        """Parts that pieces can be looked up of; or ids, of texts whose words can't be told apart here."""
        if self.special.search(text):
            return [self._whole(text)]
        out, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > STRIDE:  # words don't span white space
                cut = _SPACE.search(text, at + STRIDE)
                to = cut.end() if cut else to
            part = text[at:to] if to - at < len(text) else text
            at = to
            if not (part.isascii() or _SIMPLE.fullmatch(part)):
                out.append(self._whole(part))
                continue
            part = part.lower().replace("\n", " ")
            if not _TOUCHING.search(part):  # else a comma is part of a longer sign
                part = part.replace(", ", " , ").replace(". ", " . ")
            out.append(part)
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder: a Python worker keeps what it has learnt from one task to the next."""
    # functions travel to workers with copies of this module's globals, so what outlives a task is in a module of its own
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class SumOfSquares:
    """Windows by fill level. place() says where a piece goes, flush() what is left is cut into.

    Rows are (id, start, length, CRC-32, tokens of the document, window, offset, whether the sum of squares chose its window).
    """

    def __init__(self, first: int, window: int = WINDOW, most: int = MAX_OPEN, share: int = OPEN_SHARE):
        self.window, self.most, self.share, self.next = window, most, share, first
        self.count = np.zeros(window + 1, np.int64)  # by level; 0 and window stay 0
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.n_open = self.placed = 0

    def _level(self, size: int) -> int:
        """The level that leaves the least sum of squares, the fullest of equals; 0 for a new window, -1 if none fits and no more may be open."""
        fits = np.flatnonzero(self.count[: self.window - size + 1])
        after = np.where(fits + size < self.window, 2 * self.count[fits + size] + 1, 0)
        cost = after + 1 - 2 * self.count[fits]
        best = len(fits) - 1 - int(np.argmin(cost[::-1])) if len(fits) else -1
        if self.n_open < min(self.most, 1 + self.placed // self.share) and (best < 0 or 2 * self.count[size] + 1 < cost[best]):
            return 0
        return int(fits[best]) if best >= 0 else -1

    def place(self, piece: tuple[int, int, bytes, int]) -> Iterator[tuple]:
        """Rows of windows that are now full. A piece: id, start, ids as bytes, tokens of its document."""
        doc, start, ids, total = piece
        while len(ids) >= 4 * self.window:
            yield self._row((doc, start, ids[: 4 * self.window], total), self.next, 0)
            self.next += 1
            self.placed += 1
            start, ids = start + self.window, ids[4 * self.window :]
        while ids:
            size = len(ids) // 4
            level = self._level(size)
            if level < 0:  # filling a window of the level with most windows leaves the least sum; the emptiest of equals
                level = int(np.argmax(self.count))
                size = self.window - level
            yield from self._put((doc, start, ids[: 4 * size], total), level, size)
            start, ids = start + size, ids[4 * size :]

    def _put(self, piece: tuple, level: int, size: int) -> Iterator[tuple]:
        self.placed += 1
        if level:
            sequence, pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            sequence, pieces = self.next, []
            self.next += 1
            self.n_open += 1
        pieces.append((level, piece))
        if level + size == self.window:
            self.n_open -= 1
            yield from (self._row(p, sequence, at) for at, p in pieces)
        else:
            self.count[level + size] += 1
            self.open[level + size].append((sequence, pieces))

    def flush(self) -> Iterator[tuple]:
        """The open windows' rows: the fuller ones keep what they have, as many as all tokens can fill, and the others are cut to fill
        them, the emptiest first; what then is left goes to windows of falling powers of two."""
        left = [(level, *w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        todo = sum(level for level, _, _ in left)
        full = todo // self.window
        spare = [p for _, _, pieces in reversed(left[full:]) for _, p in pieces]
        rest = todo - sum(level for level, _, _ in left[:full])
        gaps = [(sequence, level, self.window) for level, sequence, _ in left[:full]]
        rest -= sum(end - at for _, at, end in gaps)
        for _, sequence, pieces in left[:full]:
            yield from (self._row(p, sequence, at) for at, p in pieces)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            gaps.append((self.next, 0, size))
            self.next, rest = self.next + 1, rest - size
        gaps.reverse()
        for doc, start, ids, total in spare:
            while ids:
                sequence, at, end = gaps.pop()
                cut = min(end - at, len(ids) // 4)
                yield self._row((doc, start, ids[: 4 * cut], total), sequence, at, False)
                start, ids = start + cut, ids[4 * cut :]
                if at + cut < end:
                    gaps.append((sequence, at + cut, end))
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0

    @staticmethod
    def _row(piece: tuple[int, int, bytes, int], sequence: int, at: int, placed: bool = True) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, placed


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed) of windows of at most `window` tokens, a power of two.

    A document is the tokenizer's ids and an end id, also if its text is empty or null.
    Each id lies in one piece. Windows are full but for the last few of each partition,
    which have a power of two; `placed` is false for pieces that only filled up what was open at a partition's end.
    Documents are packed in the order in which a partition has them. Rows that repeat are packed each; a null id stays null.
    Of levels that leave the same sum the fullest is taken. An empty table gives no rows.
    Other columns are ignored. Memory is bounded by an Arrow batch, the ids of one text and MAX_OPEN windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy_worker(keep=True)
        encode = encoder(tokenizer)
        packer = SumOfSquares(TaskContext.get().partitionId() << 40, window)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            found = dict(zip(columns, zip(*rows, strict=True), strict=True))
            return pd.DataFrame(found | {"doc_id": pd.array(found["doc_id"], "Int64")})

        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            docs, texts, at = batch["d"].tolist(), [t or "" for t in batch["t"].tolist()], 0
            while at < len(texts):
                to, chars = at + 1, len(texts[at])
                while to < len(texts) and chars + len(texts[to]) <= STRIDE:
                    chars += len(texts[to])
                    to += 1
                rows = []
                for doc, ids in zip(docs[at:to], encode.encode_all(texts[at:to]), strict=True):
                    ids += end
                    rows += packer.place((int(doc) if doc else None, 0, ids, len(ids) // 4))
                at = to
                if rows:
                    yield frame(rows)
        if rows := list(packer.flush()):
            yield frame(rows)

    modest_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").cast("string").alias("d"), docs[text_col].alias("t")).mapInPandas(run, SCHEMA)

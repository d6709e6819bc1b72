"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are grouped into tiles by the population counts of their blocks. Bits that
differ change a population count by one at most, so two fingerprints within the radius lie
in tiles whose counts differ by no more; other pairs of tiles are skipped. Tiles that may
hold a pair are compared in full with exclusive-or and bit counts, in numpy, and only the
links of a spanning forest leave a task: as many as there are fingerprints, not pairs.
Where links also ask for like sizes, tiles are by size as well, and those of unlike sizes are skipped too.
Where they ask for a likeness, the components of these links are only candidates: the shingle
sets of each are compared exactly, and only pairs that are so alike are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import modest_batches, tidy_worker, written
from .exact_dedup import BROADCAST_ROWS, _cells, bitmap_of, filter_bits, in_bitmap, keep_rows, row_key

SEED = 42  # of the first 64 bits, the next ones follow
DIGIT, PAD = 256, 4  # a tile key has a digit per count
STRIP, SLAB = 64, 4096  # fingerprints that are compared at once
CHUNK = 1 << 15  # shingles whose bits are unpacked at once
PART, PART_ROWS = 1 << 20, 4096  # hashes and sets of a component that are held at once
#: how `keep_one` links
NEAR = {"shingle": 5, "n_words": 3, "radius": 56, "blocks": 0, "width": 32, "tile": 1 << 14, "ratio": 0.8, "distinct": True, "alike": 0.8, "by_row": True}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], shingle: int) -> list[bytes]:
    """Runs of words, repeated ones too; fewer words are one."""
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def fingerprint(text: str | None, shingle: int, n_words: int, distinct: bool = False) -> list[int]:
    """n_words times 64 bits, signed, and the number of shingles. A bit is 1 if it is set in over half of the shingles' hashes.

    Words are runs without ASCII white space, A-Z in lower case; repeated shingles count
    again unless distinct. A text of fewer words is one shingle; null or wordless texts give zero.
    """
    return _printed(text, shingle, n_words, distinct)[0]


def _printed(text: str | None, shingle: int, n_words: int, distinct: bool) -> tuple[list[int], np.ndarray]:
    """The fingerprint, and the hashes of the shingles with the first seed. Shingles of a long text are made a chunk at a time;
    distinct ones are those whose hashes with the first seed are."""
    words = words_of(text)
    if not words:
        return [0] * (n_words + 1), np.empty(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    hashes = np.empty((n_words, n), "<u8")
    for at in range(0, n, CHUNK):
        part = shingles(words[at : at + CHUNK + shingle - 1], shingle) if n > 1 else shingles(words, shingle)
        for k in range(n_words):
            hashes[k, at : at + len(part)] = np.fromiter((xxhash.xxh64_intdigest(s, SEED + k) for s in part), "<u8", len(part))
    if distinct:
        hashes = hashes[:, np.unique(hashes[0], return_index=True)[1]]
    out = []
    for row in hashes:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(row), CHUNK):
            ones += np.unpackbits(np.ascontiguousarray(row[at : at + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(row), bitorder="little").view("<i8")[0]))
    return [*out, hashes.shape[1]], hashes[0]


def shingle_set(hashes: np.ndarray) -> tuple[bytes, int]:
    """The sorted set of hashes, and a digest of it, signed."""
    held = np.unique(hashes).tobytes()
    return held, int(np.uint64(xxhash.xxh3_64_intdigest(held)).view(np.int64))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_words: int, distinct: bool = False, by_row: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ..., size) of every row; size is the number of shingles, of distinct ones if so asked, and then `same` is a digest
    of their set. by_row adds `key`, which tells rows of one id by their texts."""
    names = [*(f"f{k}" for k in range(n_words)), "size", *["same"] * distinct]

    def one(text: str | None) -> list[int]:
        out, hashes = _printed(text, shingle, n_words, distinct)
        return [*out, shingle_set(hashes)[1]] if distinct else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy_worker()
        for batch in batches:
            found = np.array([one(t) for t in batch["t"]], np.int64).reshape(-1, len(names))
            ids = pd.array([int(i) if i else None for i in batch["doc_id"]], "Int64")
            yield pd.DataFrame({"doc_id": ids} | {f: found[:, k] for k, f in enumerate(names)} | ({"key": batch["key"]} if by_row else {}))

    schema = ", ".join(["doc_id long", *(f"{f} long" for f in names), *["key string"] * by_row])
    modest_batches(docs.sparkSession)
    key = [row_key(docs[id_col], _digest(docs[text_col])).alias("key")] * by_row
    return docs.select(docs[id_col].cast("long").cast("string").alias("doc_id"), docs[text_col].alias("t"), *key).mapInPandas(run, schema)


def _counts(n_words: int, blocks: int, width: int) -> list[Column]:
    """Population counts in steps of width: of `blocks` blocks of each word, or of all words if blocks is 0."""
    if not blocks:
        return [F.floor(sum((F.bit_count(f"f{k}") for k in range(n_words)), F.lit(0)) / width).cast("long")]
    bits = 64 // blocks
    part = lambda k, j: F.shiftrightunsigned(f"f{k}", j * bits).bitwiseAND(F.lit((1 << bits) - 1))
    return [F.floor(F.bit_count(part(k, j)) / width).cast("long") for k in range(n_words) for j in range(blocks)]


def offsets(digits: int, radius: int, width: int, sized: bool = False) -> list[int]:
    """Differences of tile keys, one of each pair of opposites, between tiles that can hold fingerprints within the radius; sized keys begin with a digit for the size."""
    reach = radius // width + 1
    least = lambda d: max(0, (abs(d) - 1) * width + 1) if d else 0
    found = []
    for step in product(*[range(-1, 2)] * sized, *[range(-reach, reach + 1)] * digits):
        if sum(map(least, step[sized:])) <= radius and step >= (0,) * len(step):
            found.append(sum(d * DIGIT ** (len(step) - 1 - i) for i, d in enumerate(step)))
    return sorted(found)


class _Tile:
    """One tile: its own fingerprints, then others that are compared with them; links of a spanning forest."""

    def __init__(self, radius: int, ratio: float = 0.0):
        self.radius, self.ratio, self.ids, self.words, self.sizes, self.root = radius, ratio, np.empty(0, np.int64), None, None, None

    def start(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(np.bitwise_count(words).sum(axis=1, dtype=np.int64), kind="stable")
        self.ids, self.words, self.sizes, self.root = ids[order], np.ascontiguousarray(words[order]), sizes[order], np.arange(len(ids))
        return self.compare(self.ids, self.words, self.sizes, own=True)

    def _hits(self, words: np.ndarray, lo: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        found = []
        for at in range(0, lo + len(words) if own else len(self.ids), SLAB):
            slab = self.words[at : at + SLAB]
            edge = np.bitwise_count(slab[[0, -1]]).sum(axis=1, dtype=np.int64)
            if ones.min() - edge[1] > self.radius or edge[0] - ones.max() > self.radius:
                continue
            apart = np.bitwise_count(np.bitwise_xor.outer(words[:, 0], slab[:, 0]))
            for k in range(1, words.shape[1]):
                apart += np.bitwise_count(np.bitwise_xor.outer(words[:, k], slab[:, k]))
            hit = np.flatnonzero(apart <= self.radius)
            if len(hit):
                found.append((hit // len(slab), hit % len(slab) + at))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            x = self.root[x]
        return x

    def compare(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, own: bool = False) -> list[tuple[int, int]]:
        links = []
        for lo in range(0, len(ids), STRIP):
            i, j = self._hits(words[lo : lo + STRIP], lo, own)
            if self.ratio:
                a, b = sizes[i + lo], self.sizes[j]
                like = np.minimum(a, b) >= self.ratio * np.maximum(a, b)
                i, j = i[like], j[like]
            if own:
                i, j = i[j < i + lo], j[j < i + lo]
            if not len(i):
                continue
            # of the hits of one fingerprint in one component, one is enough
            _, first = np.unique(i * len(self.ids) + self.root[j], return_index=True)
            last, joined = -1, -1
            for a, b in zip((i[first] + lo).tolist(), j[first].tolist(), strict=True):
                if a != last:
                    last, joined = a, self._find(a) if own else -1
                top = self._find(b)
                if top == joined:
                    continue
                links.append((int(ids[a]), int(self.ids[b])))
                if joined >= 0:
                    self.root[max(top, joined)] = min(top, joined)
                joined = top if joined < 0 else min(top, joined)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        return links


def links(reps: DataFrame, n_words: int, radius: int, blocks: int, width: int, tile: int, ratio: float = 0.0) -> DataFrame:
    """Links (u, v) that join all rows (nid, f0, ..., size) within the radius of each other, whose sizes differ by the ratio at most; distinct rows are expected.

    Every tile is sent to the tiles at a larger key that its counts allow. Tiles of more than
    `tile` rows are split by hash, and each part meets the others.
    """
    spark = reps.sparkSession
    names = [f"f{k}" for k in range(n_words)]
    counts = _counts(n_words, blocks, width)
    if ratio:  # sizes within the ratio are at most one step apart
        counts.insert(0, F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / (-math.log(ratio) * 1.01)).cast("long"))
    key = sum((c + PAD) * DIGIT ** (len(counts) - 1 - i) for i, c in enumerate(counts)) if len(counts) > 1 else counts[0] + PAD
    keyed = reps.withColumn("key", key.cast("long") if len(counts) > 1 else key)
    # there are only so many vectors of counts, whatever the number of rows
    sizes = written(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts")), "tiles", 0)
    steps = F.array(*[F.lit(x).cast("long") for x in offsets(len(counts) - bool(ratio), radius, width, bool(ratio))])
    sent = keyed.withColumn("step", F.explode(steps)).withColumn("key", F.col("key") + F.col("step"))
    sent = sent.join(F.broadcast(sizes), "key").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    own = F.pmod(F.xxhash64("nid"), F.col("parts"))
    sent = sent.where((F.col("step") != 0) | (F.col("part") >= own))
    sent = sent.withColumn("guest", ((F.col("step") != 0) | (F.col("part") != own)).cast("int"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = sent.select("key", "part", "guest", "nid", "size", *names).repartition(n, "key", "part").sortWithinPartitions("key", "part", "guest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy_worker()
        at, tile_, waiting = None, None, []

        def ready() -> list[tuple[int, int]]:
            """The tile's own rows are all here."""
            nonlocal waiting
            if not waiting:
                return []
            own = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting = []
            return tile_.start(*own)

        for batch in batches:
            found = []
            tag = batch[["key", "part", "guest"]].to_numpy(np.int64)
            ids, sizes = batch["nid"].to_numpy(np.int64), batch["size"].to_numpy(np.int64)
            words = batch[names].to_numpy(np.int64).view(np.uint64)
            cuts = np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                if at != (tag[lo, 0], tag[lo, 1]):
                    found += ready()
                    at, tile_ = (tag[lo, 0], tag[lo, 1]), _Tile(radius, ratio)
                if tag[lo, 2]:
                    found += ready()
                    if len(tile_.ids):
                        found += tile_.compare(ids[lo:hi], words[lo:hi], sizes[lo:hi])
                else:
                    waiting.append((ids[lo:hi], words[lo:hi], sizes[lo:hi]))
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])
        if found := ready():
            yield pd.DataFrame(found, columns=["u", "v"])

    return dealt.mapInPandas(run, "u long, v long")


class _Sets:
    """A part of a component: its own sets, then others that are compared with them; links of a spanning forest of the pairs that are alike."""

    def __init__(self, alike: float):
        self.alike, self.ids = alike, np.empty(0, np.int64)

    def start(self, ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        self.ids, self.sizes, self.label = ids, np.array([len(s) for s in sets], np.int64), np.arange(len(ids))
        held, of = np.concatenate(sets), np.repeat(np.arange(len(ids)), self.sizes)
        order = np.argsort(held, kind="stable")
        self.held, self.of = held[order], of[order]
        return self.compare(ids, sets, own=True)

    def compare(self, ids: np.ndarray, sets: list[np.ndarray], own: bool = False) -> list[tuple[int, int]]:
        links = []
        for i, one in enumerate(sets):
            lo, hi = np.searchsorted(self.held, one, "left"), np.searchsorted(self.held, one, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            shared = np.bincount(self.of[at], minlength=len(self.ids))
            hit = np.flatnonzero(shared / np.maximum(self.sizes + len(one) - shared, 1) >= self.alike)
            hit = hit[hit < i] if own else hit
            # of the hits in one tree, one is enough
            trees, first = np.unique(self.label[hit], return_index=True)
            links += [(int(ids[i]), int(self.ids[j])) for j in hit[first]]
            trees = np.append(trees, self.label[i]) if own else trees
            if len(trees) > 1:
                self.label[np.isin(self.label, trees)] = trees.min()
        return links


def alike_links(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, rows: int, shingle: int, alike: float) -> DataFrame:
    """Links (u, v) that join the nodes (nid, root, first, size, same) of one root whose shingle sets have a likeness (shared of all) of at least `alike`.

    Sets are of 64-bit hashes, and made again of the texts of the nodes' first ids, which a Bloom bitmap picks. A root of more
    than PART hashes or PART_ROWS nodes is split by hash, and each part meets the others.
    """
    spark = docs.sparkSession
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("")).alias("key")
    nodes = written(nodes.select("nid", "root", "size", "same", key(F.col("first"))), "candidates", rows)
    count = nodes.count()
    bits = filter_bits(count)
    blocks = bitmap_of(nodes.select(F.explode(F.array(*_cells(F.col("key"), bits))).alias("cell")))
    asked = in_bitmap(docs.select(F.struct(docs[text_col].alias("t")).alias("row"), key(docs[id_col])), "key", blocks, bits).where("maybe")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy_worker()
        for batch in batches:
            found = [shingle_set(_printed(t, shingle, 1, True)[1]) for t in batch["t"]]
            yield pd.DataFrame({"key": batch["key"], "same": [d for _, d in found], "held": [h for h, _ in found]})

    modest_batches(spark)
    sets = asked.select("key", "row.t").mapInPandas(hashed, "key string, same long, held binary")
    parts = F.greatest(F.ceil(F.sum("size") / PART), F.ceil(F.count("*") / PART_ROWS)).cast("long")
    large = written(nodes.groupBy("root").agg(parts.alias("parts")).where("parts > 1"), "large", 0)
    dealt = sets.join(F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes, ["key", "same"]).join(F.broadcast(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("nid"), F.col("parts"))).withColumn("part", F.explode(F.expr("sequence(own, parts - 1)")))
    dealt = dealt.select("root", "part", (F.col("part") != F.col("own")).cast("int").alias("guest"), "nid", "held")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(n, "root", "part").sortWithinPartitions("root", "part", "guest", "nid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy_worker()
        at, group, ids, sets, done = None, None, [], [], None

        def ready() -> list[tuple[int, int]]:
            """The part's own rows are all here."""
            nonlocal ids, sets
            own, ids, sets = (np.array(ids, np.int64), sets), [], []
            return group.start(*own) if own[1] else []

        for batch in batches:
            found = []
            for root, part, guest, nid, held in zip(*(batch[c] for c in ("root", "part", "guest", "nid", "held")), strict=True):
                if at != (root, part):
                    found += ready()
                    at, group = (root, part), _Sets(alike)
                if done == (root, part, nid):
                    continue  # another row of the same id and text
                done = (root, part, nid)
                held = np.frombuffer(held, "<u8")
                if guest:
                    found += ready()
                    if len(group.ids):
                        found += group.compare(np.array([nid]), [held])
                else:
                    ids.append(nid)
                    sets.append(held)
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])
        if found := ready():
            yield pd.DataFrame(found, columns=["u", "v"])

    return dealt.mapInPandas(run, "u long, v long")


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    n_words: int = 1,
    radius: int = 2,
    blocks: int = 4,
    width: int = 1,
    tile: int = 8192,
    ratio: float = 0.0,
    distinct: bool = False,
    alike: float = 0.0,
    by_row: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, f0, ..., component_id: the least id reachable over links, its own included.

    by_row adds key (the row's id and text digest), keep_key (that of the component's first row, null ids last) and members (its rows).

    With a ratio, documents only link if the smaller number of shingles is at least that share of the larger; a likeness of
    sets bounds the ratio of distinct shingles only, so `distinct` counts each shingle of a text once.
    With a likeness `alike`, which needs `distinct`, links within the radius are candidates, and of each component of them those pairs link
    whose sets are at least so alike; equal sets are then one node.
    Equal fingerprints (of one size, with a ratio) are one node, so copies make no links. Null and wordless texts have
    fingerprint zero and link like others. Rows with a null id count but give no
    component_id of their own. Other columns are ignored; an empty table gives no rows.
    """
    names = [f"f{k}" for k in range(n_words)]
    prints = written(fingerprints(docs, id_col, text_col, shingle, n_words, distinct, by_row), "fingerprints")
    if distinct:
        keys = [*names, "size", "same"]
    elif ratio:
        keys = [*names, "size"]
    else:
        keys, prints = names, prints.withColumn("size", F.lit(0).cast("long"))
    reps = prints.groupBy(*names, "size", *["same"] * distinct).agg(
        F.min("doc_id").alias("first"), *[F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("keep"), F.count("*").alias("members")] * by_row
    )
    rows = prints.count()
    reps = written(reps.withColumn("nid", F.monotonically_increasing_id()), "distinct", rows)
    found = written(links(reps, n_words, radius, blocks, width, tile, ratio), "links")
    labels = components(found).withColumnRenamed("node", "nid")
    if alike:
        nodes = reps.join(labels.withColumnRenamed("component", "root"), "nid")
        labels = components(written(alike_links(docs, id_col, text_col, nodes, rows, shingle, alike), "alike")).withColumnRenamed("node", "nid")
    rooted = written(reps.join(labels, "nid", "left").withColumn("root", F.coalesce("component", "nid")), "rooted", rows)
    more = [F.min("keep").getField("key").alias("keep_key"), F.sum("members").alias("members")] * by_row
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), *more), "least", rows)
    also = ["keep_key", "members"] * by_row
    rooted = written(rooted.drop(*also).join(least, "root").select(*keys, "component_id", *also), "labelled", rows)
    return prints.join(rooted, keys).select("doc_id", *names, "component_id", *["key"] * by_row, *also)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 64 bits of 3-word shingles, linked at two differing bits or fewer."""
    out = near_components(docs, id_col, text_col)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the least id, of each group of near copies; all columns as they were.

    Near copies are texts whose sets of five-word shingles are alike at 0.8 or more (64-bit hashes of
    the shingles), and what such pairs join. Candidates are texts whose 192 bits of distinct shingles differ in 56 or
    fewer: at a likeness of 0.8, 29 differ on average, and more than 56 in 2 of 10^4 pairs of
    five shingles and 3 of 10^7 of longer texts if hashes are random. Population counts rule out hardly any tiles at this radius, but sets that
    are so alike have sizes (distinct shingles) within 0.8 of each other, which rules out most.
    A row goes by its id and text, so that another text of the same id, or of a null one, isn't lost; of rows
    with the id and text that stay, the one whose columns have the least hash stays.
    """
    out = near_components(docs, id_col, text_col, **NEAR).where("members > 1")
    acts = out.groupBy("key").agg(F.max(F.col("key") != F.col("keep_key")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1")
    return keep_rows(docs, row_key(docs[id_col], _digest(docs[text_col])), acts.select("key", "gone"), docs.count())

"""Exact dedup by two passes over a Bloom bitmap: only rows whose cell is hit twice shuffle.

The first pass finds the cells of a bit array that at least two rows fall into. Rows are dealt
into groups as they lie, and each task makes bitmaps of its groups, so bitmaps are exchanged and
rows aren't. A cell that two groups have is in the bitmaps of both sides of some bit of the group's
number; a cell that one group has twice shows as a block with more rows than bits, and only the rows of such
blocks are counted by cell. The second pass tests each row against the result. A row whose
cell is unmarked has no equal and passes straight through; the others, 32-byte digests and never
texts, are grouped exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

WHITE = r"[\x20\x09-\x0D]+"
BLOCK_BITS = 32768  # of one bitmap_construct_agg
BITS_PER_ROW = 32
MAX_BITS = 1 << 30  # the broadcast bitmap is at most 128 MB
GROUPS = 16  # of rows, at least and at most twice as many
HOT_GROUPS = 1024  # at most so many groups are joined by broadcast
BROADCAST_ROWS = 500_000  # so many keys of rows, of some 100 bytes, are broadcast at most


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _cells(key: Column, bits: int, hashes: int = 2) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(bits - 1)) for seed in range(1, hashes + 1)]


def filter_bits(rows: int, per_row: int | None = None, most: int | None = None) -> int:
    """A power of two of at least per_row bits a row, between one block and most."""
    return min(most or MAX_BITS, max(BLOCK_BITS, 1 << max(1, rows * (per_row or BITS_PER_ROW) - 1).bit_length()))


def _block(cell: str = "cell") -> Column:
    return F.shiftright(cell, 15)


def _bit(cell: str = "cell") -> Column:
    return F.col(cell).bitwiseAND(F.lit(BLOCK_BITS - 1))


def bitmap_of(cells: DataFrame) -> DataFrame:
    """Bitmap blocks (block, bitmap) of a table of cells; as many bytes as there are bits / 8 at most."""
    return written(cells.groupBy(_block().alias("block")).agg(F.bitmap_construct_agg(_bit()).alias("bitmap")), "bloom", 0)


def in_bitmap(rows: DataFrame, key: str, blocks: DataFrame, bits: int, hashes: int = 2) -> DataFrame:
    """rows, whose columns are `row` and key, with a boolean `maybe`: false only if a cell of the key isn't marked."""
    bit_of = F.array(*[F.lit(1 << k) for k in range(8)])
    hit = F.lit(True)
    for i, cell in enumerate(_cells(F.col(key), bits, hashes)):
        rows = rows.withColumn(f"c{i}", cell).withColumn(f"k{i}", F.shiftright(f"c{i}", 15))
        rows = rows.join(F.broadcast(blocks.select(F.col("block").alias(f"k{i}"), F.col("bitmap").alias(f"b{i}"))), f"k{i}", "left")
        at = F.col(f"c{i}").bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"b{i}"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.element_at(bit_of, at.bitwiseAND(F.lit(7)) + 1)
        hit = hit & F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    return rows.select("row", key, hit.alias("maybe"))


def group_bitmaps(digests: DataFrame, bits: int, tasks: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their group and cell, the groups' bitmaps (grp, block, n, bitmap) and the number of groups.

    A group is of rows that one task wrote, or of a share of them where tasks are few.
    """
    slices = -(-GROUPS // tasks)
    task = F.pmod(F.shiftright("rid", 33), F.lit(GROUPS))
    grp = task * slices + F.pmod(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(slices))
    rows = digests.select(grp.cast("int").alias("grp"), _cells(F.col("digest"), bits, 1)[0].alias("cell")).withColumn("block", _block())
    maps = rows.groupBy("grp", "block").agg(F.count("*").alias("n"), F.bitmap_construct_agg(_bit()).alias("bitmap"))
    return rows, maps, min(tasks, GROUPS) * slices


def repeated_cells(digests: DataFrame, bits: int, tasks: int) -> DataFrame:
    """The first pass: bitmap blocks (block, bitmap) of the cells that two or more rows fall into. Digests have `rid`,
    whose upper 31 bits say which of the `tasks` tasks wrote the row."""
    rows, maps, groups = group_bitmaps(digests, bits, tasks)
    maps = written(maps, "groups-bloom", 0)
    # two groups differ in some bit of their numbers
    sides = F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright("grp", j).bitwiseAND(F.lit(1)).alias("side")) for j in range(max(1, (groups - 1).bit_length()))])
    either = maps.select("block", "bitmap", F.explode(sides).alias("s")).groupBy("block", "s.j", "s.side").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    both = either.groupBy("block", "j").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("sides")).where("sides = 2")
    across = both.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    # a block of a group with more rows than marked bits; of as many as there are blocks times groups, all of them bounded
    full = maps.where(F.col("n") > F.bitmap_count("bitmap")).select("grp", "block")
    within = rows.join(F.broadcast(full), ["grp", "block"], "left_semi").groupBy("cell").count().where("count > 1")
    within = within.groupBy(_block().alias("block")).agg(F.bitmap_construct_agg(_bit()).alias("bitmap"))
    return written(across.unionByName(within).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), "bloom", 0)


def keep_rows(docs: DataFrame, key: Column, acts: DataFrame, most: int | None = None, max_bits: int | None = None) -> DataFrame:
    """docs but for the rows whose key is one that `acts` (key, gone) says is gone, all columns as they were.

    Of the rows of a key that is there and not gone one stays: the one whose columns have the least hash, as JSON.
    Up to BROADCAST_ROWS acts are broadcast. Of more, a Bloom bitmap is: rows whose key it rules out pass straight through, and the others are
    joined. most is at least the number of rows of acts, if that is known.
    """
    acts = written(acts.groupBy("key").agg(F.min("gone").alias("gone")), "acts", most)
    found = acts.agg(F.count("*").alias("n"), F.count_if(~F.col("gone")).alias("again")).first()
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    out = None
    if found.n <= BROADCAST_ROWS:
        acts, asked = F.broadcast(acts), keyed
    else:
        bits = filter_bits(found.n, most=max_bits)
        blocks = bitmap_of(acts.select(F.explode(F.array(*_cells(F.col("key"), bits))).alias("cell")))
        marked = in_bitmap(keyed, "key", blocks, bits)
        out, asked = marked.where("not maybe").select("row"), marked.where("maybe")
    kept = asked.join(acts, "key", "left_anti").select("row")
    out = kept if out is None else out.unionByName(kept)
    if not found.again:
        return out.select("row.*")
    asked = asked.join(acts, "key")
    again = asked.where("not gone").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return out.unionByName(again.select("row")).select("row.*")


def row_key(id_col: Column, digest: Column) -> Column:
    """What a row is told by where ids are null or repeat: its id and the digest of its text, as hex."""
    return F.concat(digest, F.coalesce(F.concat(F.lit(":"), id_col.cast("string")), F.lit("")))


def _hex_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if equal after `normalised`. The row with the least id stays; null ids
    come last, and of rows with the same id and text one stays. Null text counts as empty.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    The bitmap has BITS_PER_ROW bits a row up to max_bits, a broadcast; beyond that more rows are let through
    to the exact grouping, and the result is the same.
    """
    digests = written(
        docs.select(
            docs[id_col].alias("doc_id"),
            F.unhex(_hex_digest(docs[text_col])).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "digests",
    )
    found = digests.agg(F.count("*").alias("n"), F.max(F.shiftright("rid", 33)).alias("last")).first()
    rows = found.n
    bits = filter_bits(rows, most=max_bits)
    blocks = repeated_cells(digests, bits, int(found.last or 0) + 1)
    marked = in_bitmap(digests.select("digest", F.struct("doc_id", "rid").alias("row")), "digest", blocks, bits, 1)
    marked = written(marked.select("digest", "row.doc_id", "row.rid", "maybe"), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    maybe = marked.where("maybe")
    groups = written(
        maybe.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(first).alias("least")), "groups", rows
    )
    hot_from = max(1000, rows // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col("group_size") >= hot_from)), groups.where(F.col("group_size") < hot_from)
    grouped = maybe.join(hot, "digest").unionByName(
        maybe.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest")
    )
    alone = marked.where("not maybe").select(
        "digest", "doc_id", "rid", "maybe", F.lit(1).cast("long").alias("group_size"), first.alias("least")
    )
    return grouped.select(alone.columns).unionByName(alone).select(
        "doc_id",
        F.col("least.doc_id").alias("keep_id"),
        "group_size",
        (F.col("least.rid") == F.col("rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first of each group of equal texts, all columns as they were.

    A row goes by its id and text, so that another text of the same id, or of a null one, isn't lost. Of
    rows with the id and text that stay, the one whose columns have the least hash stays.
    """
    out = exact_dedup(docs, id_col, text_col)
    key = row_key(F.col("doc_id"), F.col("text_sha256"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    acts = out.where("not kept").select(key.alias("key"), (~first).alias("gone"))
    return keep_rows(docs, row_key(docs[id_col], _hex_digest(docs[text_col])), acts, docs.count())

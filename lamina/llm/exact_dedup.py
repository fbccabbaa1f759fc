"""Exact duplicates by deterministic block naming, in DataFrame operations alone.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and their places become
integer names; then adjacent pairs of names are named in the same way, again and again, until each document
has one name. Names are places in a sorted order of distinct contents, never hashes, so two documents have the
same number of rounds and the same name exactly if their texts are equal.

A block moves once, to its equals. What is left of distinct contents is counted by 128-bit keys: a key of one content is
free of collisions, and stands for it in the sorting, so that windows and joins move keys and places alone. Blocks
whose key collides are sorted and joined by content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, meet, meet_counted, pieces, row_of, settled, table, without

#: Bytes of a block.
BLOCK = 4096
#: Distinct blocks or pairs that are sorted together.
BUCKET_ROWS = 100_000


def normalised(text: Column) -> Column:
    """Without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _blocks(data: Column, size: int) -> Column:
    """Array of blocks of bytes; no bytes are one empty block."""
    last = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int") - 1
    return F.when(last == 0, F.array(data)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size))))


def _key(block: Column, bits: int) -> tuple[Column, Column]:
    """Two longs; with bits under 64 the first is masked and the second left out, so that tests meet collisions."""
    if bits < 64:
        return F.xxhash64(block).bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0).cast("long")
    return F.xxhash64(block), F.xxhash64(F.lit(7), block)


def _named(distinct: DataFrame, order: list[str], rows: int, sign: int) -> DataFrame:
    """distinct with a column name: the place in order of its bucket, and the bucket; names of one sign differ."""
    n = pieces(rows, BUCKET_ROWS)
    own = W.partitionBy("__b").orderBy(*order)
    placed = distinct.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(n)))
    return placed.withColumn("name", sign * (F.col("__b") * F.lit(1 << 40) + F.row_number().over(own))).drop("__b")


def block_names(blocks: DataFrame, scratch: Scratch, total: int) -> tuple[DataFrame, DataFrame | None]:
    """Of total rows (k1, k2, block): written tables (k1, k2, n, name) of keys with one content, n rows each, and
    (k1, k2, block, name) of the others or None."""
    distinct = blocks.groupBy("k1", "k2", "block").agg(F.count(F.lit(1)).alias("n"))
    keys = scratch.keep(distinct.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n")))
    clear = scratch.keep(_named(keys.where("contents = 1").drop("contents"), ["k1", "k2"], total, 1))
    clashing = keys.where("contents > 1").select("k1", "k2")
    if clashing.isEmpty():
        return clear, None
    contents = distinct.select("k1", "k2", "block").join(clashing, ["k1", "k2"], "left_semi")
    return clear, scratch.keep(_named(contents, ["k1", "k2", "block"], total, -1))


def identify(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per row of a settled table: row, doc_id, chars (code points of the text), text_sha256, rounds int, name long.

    rounds and name together are a document's identity: equal for equal normalised texts, different for others.
    """
    text = normalised(F.col(text_col)).cast("binary")
    base = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), text.alias("norm"))
    base = base.withColumn("blocks", _blocks(F.col("norm"), block))

    def keys(b: Column) -> Column:
        x, y = _key(b, bits)
        return F.struct(x.alias("k1"), y.alias("k2"))

    rows = base.select("row", "doc_id", "chars", F.sha2("norm", 256).alias("text_sha256"), F.transform("blocks", keys).alias("keys"))
    rows = scratch.keep(rows)  # documents keep the keys of their blocks
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    k1, k2 = _key(F.col("block"), bits)
    each = base.select(F.explode("blocks").alias("block")).select(k1.alias("k1"), k2.alias("k2"), "block")
    clear, clashing = block_names(each, scratch, total)

    flat = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "k")).select("row", F.col("n").alias("of"), "at", "k.k1", "k.k2")
    names = meet_counted(flat, clear, ["k1", "k2"], total).select("row", "of", "at", "name")
    if clashing is not None:
        parts = base.select("row", F.size("blocks").alias("of"), F.posexplode("blocks").alias("at", "block"))
        names = names.unionByName(meet(parts, clashing.select("block", "name"), "block").select("row", "of", "at", "name"))
    level = scratch.keep(names)

    done = [level.where("of = 1").select("row", F.lit(0).alias("rounds"), "name")]
    rounds = 0
    longest = level.agg(F.max("of")).first()[0] or 0
    while longest > 1:
        rounds += 1
        level, longest = _halve(level.where("of > 1"), scratch), -(-longest // 2)
        done.append(level.where("of = 1").select("row", F.lit(rounds).alias("rounds"), "name"))
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    return rows.drop("keys").join(ends, "row")


def _halve(level: DataFrame, scratch: Scratch) -> DataFrame:
    """Names of adjacent pairs; the last of an odd number is a pair with nothing (0)."""
    even = F.col("at") % 2 == 0
    pairs = level.groupBy("row", "of", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
    pairs = scratch.keep(pairs.select("row", F.ceil(F.col("of") / 2).cast("int").alias("of"), "at", "a", "b"))
    total = pairs.count()
    named = scratch.keep(_named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], total, 1))
    out = scratch.keep(meet_counted(pairs, named, ["a", "b"], total).select("row", "of", "at", "name"))
    scratch.drop(pairs, named)
    return out


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size long, kept boolean, text_sha256.

    Texts are equal if they are so without ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the one with the smallest doc_id (null first), then, of repeated rows, one.
    """
    docs = settled(docs)
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep(identify(docs, scratch, id_col, text_col, block, bits))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = scratch.keep(ids.groupBy("rounds", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).withColumn("n", F.col("group_size")))
    out = meet_counted(ids, groups, ["rounds", "name"], ids.count())
    return out.select(F.col("doc_id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs, as find_duplicates has it of nulls, ties and repeated rows.

    Of rows that repeat whole, one stays; an empty table stays empty.
    """
    docs = settled(docs)
    return without(docs, find_duplicates(docs, id_col, text_col).where("not kept"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find_duplicates(table(spark, sf_dir, "documents")).drop("row")


#: Equal texts by their normalised form; sha256 of it as in the contract.
SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A table keeps the bits of a fingerprint whose 3-bit code has odd parity with the table's number. Two differing
bits leave a number with which both codes have even parity, so two fingerprints within RADIUS 2 agree on all
kept bits of some of the 7 tables: no linked pair is missed. Fingerprints that share a bucket are not compared
pair by pair: each names itself and all fingerprints one bit away, among the bits its table drops, as centres.
Two fingerprints within the radius share a centre, and what shares a centre is within the radius; a centre has
65 fingerprints at most. Links are thus exact and their number is in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, meet_counted, row_of, settled, table, tune, without
from .components import components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
SHINGLE, SEED, RADIUS = 3, 42, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Kept bits of each table. Codes of the bits: 1 to 7 in turn.
MASKS = [sum(1 << i for i in range(64) if bin((i % 7 + 1) & v).count("1") % 2) for v in range(1, 1 << (RADIUS + 1))]


def fingerprint(text: str | None) -> int:
    """Of a whole text; a text without words (null too) has 0."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII alone
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, fp long (signed) of each row's whole text."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["row", "doc_id", "fp"])

    columns = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(run, f"row {columns.schema['row'].dataType.simpleString()}, doc_id {kind}, fp long")


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: of distinct fingerprints fp, links that connect all within RADIUS of each other."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(MASKS)])
    dealt = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("bucket"))
    shared = scratch.keep(dealt.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    near = dealt.join(bounded(shared), ["t", "bucket"]).select("fp", "t")
    flips = F.lit(0).cast("long")
    for t, m in enumerate(MASKS):
        dropped = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1])
        flips = dropped if t == 0 else F.when(F.col("t") == t, dropped).otherwise(flips)
    centres = near.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).distinct()
    around = centres.groupBy("centre").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return around.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row, doc_id, fingerprint (hex), component_id, best boolean.

    component_id is the smallest doc_id that links reach (null ids count only where there are no others); best
    marks one row of each component: of that doc_id, the first. Texts without words are linked to each other.
    """
    docs = settled(docs)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, id_col, text_col))
    prints = scratch.keep(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("of"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")))
    roots = scratch.keep(components(links(prints.select("fp"), scratch), scratch))
    rooted = prints.join(bounded(roots), F.col("fp") == F.col("node"), "left").select("fp", "of", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    linked = scratch.keep(roots.join(rooted.withColumnRenamed("root", "r"), F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n")))
    by_print = scratch.keep(rooted.join(bounded(linked), "root", "left").select("fp", "of", F.coalesce("best", "first").alias("best")))
    scratch.drop(roots, rooted, linked)
    out = meet_counted(rows, by_print, ["fp"], rows.count(), "of")
    return out.select("row", F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("best"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best row of each component, with all columns of docs.

    Null and empty texts are one component, of which one row stays; of rows that repeat whole, one stays; an empty
    table stays empty.
    """
    docs = settled(docs)
    return without(docs, find_groups(docs, id_col, text_col).where("not best"))


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return find_groups(table(spark, sf_dir, "documents")).drop("row", "best")

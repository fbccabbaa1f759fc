"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Of each WINDOW - GRAM + 1 consecutive hashes of GRAM words, the smallest is a fingerprint (the leftmost of equal
ones). A span of WINDOW words that a document and a benchmark item share has the same smallest hash at the same
place in both, so joining fingerprints misses none; each match is then extended word by word on both sides,
which also tells hash collisions from real matches. Items of fewer than WINDOW words have one fingerprint, of
all their words, and are looked up at every place of a document.

Documents are read in pieces of PIECE words that overlap by a window less one, so that memory depends on a piece
and not on a document. Only the benchmark's hashes meet the pieces; what they find, a place and the words around
it, is written, and everything later works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet, row_of, settled, small, table, without

#: Words of a window, and words of a hashed gram.
WINDOW, GRAM = 13, 8
#: Windows that start in a piece of a document.
PIECE = 4096
#: Low bits of a fingerprint that hold its place in a piece; the bits above hold the hash.
PLACE_BITS = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _with(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pairs(a: Column, b: Column, shift: int, f) -> Column:
    """f of a's elements and b's elements so many places further on, as far as there are both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), f)


def _runs(values: Column, n: int, f, then) -> Column:
    """then(array of f over each n consecutive values), from arrays for powers of two."""
    bits = [1 << i for i in range(n.bit_length()) if n >> i & 1]

    def grow(power: Column, size: int, done: Column | None, at: int) -> Column:
        if size in bits:
            merged = power if done is None else _pairs(done, power, at, f)
            if size == bits[-1]:
                return then(merged)
            return _with(merged, lambda m: _with(_pairs(power, power, size, f), lambda p: grow(p, 2 * size, m, at + size)))
        return _with(_pairs(power, power, size, f), lambda p: grow(p, 2 * size, done, at))

    return grow(values, 1, None, 0)


def _packed(hashes: Column) -> Column:
    return F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))


def _mix(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _salted(n: int):
    """Hashes of short items of one length differ from those of others."""
    return lambda h: F.xxhash64(h, F.lit(n))


def _fingerprints(words: Column, lengths: list[int]) -> Column:
    """Array of longs, hash above place, of the words' windows and of the grams of each short length."""

    def prints(h: Column) -> Column:
        least = _runs(h, GRAM, _mix, lambda g: _with(_packed(g), lambda v: _runs(v, WINDOW - GRAM + 1, lambda a, b: F.least(a, b), lambda m: m)))
        short = [_runs(h, n, _mix, lambda g, n=n: _packed(F.transform(g, _salted(n)))) for n in lengths]
        return F.concat(F.array_distinct(least), *short)

    return _with(F.transform(words, lambda w: F.xxhash64(w)), prints)


def _hash(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_PLACE)).cast("int")


def _around(words: Column, place: Column) -> tuple[Column, Column]:
    """Words before the place, nearest first, and from it on, as many as a window around its gram can reach."""
    start = F.greatest(place - (WINDOW - GRAM), F.lit(0))
    return F.reverse(F.slice(words, start + 1, place - start)), F.slice(words, place + 1, F.lit(WINDOW))


def _common(a: Column, b: Column) -> Column:
    """Number of equal elements from the start."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    return F.when(at == 0, F.greatest(F.size(a), F.size(b))).otherwise(at - 1)


def _pieces(words: Column) -> Column:
    """Array of (place of the first word, words of the piece); every window is whole in one piece, no words are one empty piece."""
    last = F.floor(F.greatest(F.size(words) - WINDOW, F.lit(0)) / PIECE).cast("int")
    many = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * PIECE).alias("from"), F.slice(words, i * PIECE + 1, F.lit(PIECE + WINDOW - 1)).alias("words")))
    return F.when(last == 0, F.array(F.struct(F.lit(0).alias("from"), words.alias("words")))).otherwise(many)


def benchmark_prints(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(hash, b_left, b_right, need, key, items) of each distinct surrounding of a fingerprint, with the ids (as text) of
    its items, a null id too; and the lengths of short items."""
    base = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.size("words")
    lengths = sorted(r[0] for r in base.where(size < WINDOW).select(size.alias("n")).distinct().collect())  # WINDOW - 1 at most
    whole = base.where(size >= WINDOW).select("item_id", F.explode(_pieces(F.col("words"))).alias("p")).select("item_id", F.col("p.words").alias("words"), F.lit(WINDOW).alias("need"))
    df = whole.withColumn("v", F.explode(_fingerprints(F.col("words"), [])))
    for n in lengths:
        df = df.unionByName(base.where(size == n).withColumn("need", F.lit(n)).withColumn("v", F.explode(_only_short(F.col("words"), n))).select("item_id", "words", "need", "v"))
    left, right = _around(F.col("words"), _place(F.col("v")))
    df = df.select("item_id", _hash(F.col("v")).alias("hash"), left.alias("b_left"), right.alias("b_right"), "need")
    own = ["hash", "b_left", "b_right", "need"]
    key = F.sha2(F.concat_ws(" ", F.col("need").cast("string"), F.size("b_left").cast("string"), "b_left", "b_right"), 256)
    return df.groupBy(*own).agg(F.collect_set(F.struct("item_id")).alias("items")).withColumn("key", key), lengths


def _only_short(words: Column, n: int) -> Column:
    """The fingerprint of an item of n words."""
    return _with(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _runs(h, n, _mix, lambda g: _packed(F.transform(g, _salted(n)))))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int | None = None) -> DataFrame:
    """One row per row of docs: row, doc_id, n_words int, spans array<struct<s, e>> of hit words, items array<string>.

    Spans are half-open, in words, sorted, and may overlap. A null or empty text, or an empty table of items,
    has no spans. Repeated rows give a row each; items with the same text are all listed, a null item_id as null.
    Only the ids and texts of either table are read, so that other columns may have any name. limit: bytes that may
    be broadcast (see meet).
    """
    docs = settled(docs)
    scratch = Scratch(docs.sparkSession)
    known, lengths = benchmark_prints(items, item_col, item_text)
    known = scratch.keep(known)
    hashes = known.select("hash").distinct()
    base = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    base = base.select("row", "doc_id", F.size("words").alias("n_words"), F.explode(_pieces(F.col("words"))).alias("p"))
    # a null after the fingerprints of the first piece stands for the document itself
    itself = F.when(F.col("p.from") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
    each = base.select("row", "doc_id", "n_words", F.col("p.from").alias("from"), F.col("p.words").alias("words"), F.explode(F.concat(_fingerprints(F.col("p.words"), lengths), itself)).alias("v"))
    left, right = _around(F.col("words"), _place(F.col("v")))
    context = ["row", "doc_id", "n_words", "hash", (F.col("from") + _place(F.col("v"))).alias("at"), left.alias("left"), right.alias("right")]
    each = each.withColumn("hash", _hash(F.col("v")))
    if small(known.select("hash"), limit):  # what is found alone takes the words around it along
        found = each.join(F.broadcast(hashes.withColumn("known", F.lit(True))), "hash", "left").where("v IS NULL OR known").select(*context)
    else:
        some = each.where("v IS NOT NULL").select(*context)
        found = meet(some, scratch.keep(hashes), "hash", limit).select(some.columns).unionByName(each.where("v IS NULL").select("row", "doc_id", "n_words"), allowMissingColumns=True)
    found = scratch.keep(found)
    hits = meet(found.where("hash IS NOT NULL").select("row", "at", "hash", "left", "right"), known.select("hash", "b_left", "b_right", "need", "key"), "hash", limit)
    hits = hits.withColumn("l", _common(F.col("left"), F.col("b_left"))).withColumn("r", _common(F.col("right"), F.col("b_right")))
    span = F.struct((F.col("at") - F.col("l")).alias("s"), (F.col("at") + F.col("r")).alias("e"))
    per = hits.where("l + r >= need").groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("key").alias("keys"))
    named = meet(per.select("row", F.explode("keys").alias("key")), known.select("key", "items"), "key", limit)
    named = named.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("items"))
    out = found.where("hash IS NULL").select("row", "doc_id", "n_words").join(per.select("row", "spans").join(named, "row"), "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans"), F.coalesce(F.col("items.item_id"), F.array().cast("array<string>")).alias("items"))


def contamination(hits: DataFrame) -> DataFrame:
    """The contract's columns of what find_hits returns, and row."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", zero, lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["e"]).alias("upto")))["n"]
    ids = F.array_join(F.array_sort("items"), ",")
    out = hits.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The clean rows, with all columns of docs.

    A row whose text is null or empty has no words and stays; with no items all rows stay. Repeated rows are judged
    alike, each for itself; an empty table stays empty.
    """
    docs = settled(docs)
    return without(docs, contamination(find_hits(docs, items)).where("contaminated"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("row")


#: All windows of all items, looked up at every place of every document.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

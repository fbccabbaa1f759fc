"""Balanced sharding by label propagation under capacity quotas, in DataFrame operations alone.

Documents of equal texts are linked. Linked documents start spread over the shards; in each round every group's
counts per shard name the shard that most of it should go to, and members elsewhere move there as far as the
shard's free places and those of its leavers let them, so that full shards swap. Rounds go on while they lower the
number of cut links. Groups still cut then are placed by an exact last step: the larger ones by best fit, the others
by a gapless number dealt into the room left. Documents without links go last and fill what is free, so that row
counts differ by one at most (law "rows"). A group of over half a shard can't be moved as one: there are fewer than
two such groups per shard, and they are given whole shards, or parts, beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, bounded, dense_index, meet_counted, pieces, row_of, settled, table

SHARDS = 40
#: Linked documents of a shard per bucket in which movers are numbered.
QUOTA_ROWS = 20_000
#: Cut groups of more than a shard's rows over this are packed one by one in the driver: fewer than PACKED a shard.
PACKED = 64


def _longs(xs: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in xs])


def _slot_of(index: Column, room: list[int]) -> Column:
    """The shard in whose share of room[0] + room[1] + .. places the index falls."""
    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at)
    return F.size(F.filter(_longs(ends), lambda e: e <= index)).cast("int")


def _give_giants(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each size (largest first), shards and numbers of places; whole shards first, then the best fit."""
    out = []
    for size in sizes:
        got = []
        while size:
            fits = [s for s, r in enumerate(room) if r >= size]
            s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(size, room[s])
            got.append((s, take))
            room[s] -= take
            size -= take
        out.append(got)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard int, slot long, linked boolean.

    Null texts count as empty ones, and empty texts are equal to each other. Repeated rows and null ids are rows
    like others. With fewer rows than shards some shards stay empty; an empty table gives an empty result.
    """
    docs = settled(docs.select(id_col, text_col))
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"))
    base = scratch.keep(base.withColumn("h", F.xxhash64("row", "doc_id")))
    n = base.count()
    groups = scratch.keep(base.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    counted = groups.withColumn("n", F.col("m"))
    marked = meet_counted(base.select("row", "h", "g"), counted, ["g"], n, how="left")
    marked = scratch.keep(marked.withColumn("m", F.coalesce("m", F.lit(1).cast("long"))))
    room = [n // shards + (s < n % shards) for s in range(shards)]

    large = F.col("m") * 2 * shards > n
    giants = groups.where(large).orderBy(F.desc("m"), "g").limit(2 * shards).collect()  # fewer than 2 * shards
    placed = []
    if giants:
        shares = _shares(docs.sparkSession, giants, _give_giants([r.m for r in giants], room))
        placed.append(_share_out(marked.where("m > 1").where(large), shares, scratch, n))

    linked = scratch.keep(marked.where("m > 1").where(~large))
    count = linked.count()
    if count:
        everything = F.lit(0).alias("k")
        at = dense_index(linked.withColumn("k", everything), scratch, ["k"], "h", [F.col("h"), F.col("row")], "i", pieces(n))
        start = _slot_of(F.floor(F.col("i").cast("decimal(38,0)") * sum(room) / count).cast("long"), room)
        now = scratch.keep(at.select("row", "h", "g", "m", start.alias("s")))
        cut = _cut(now)
        while cut:
            after = _propagate(now, scratch, room, count)
            left = _cut(after)
            if left >= cut:
                scratch.drop(after)
                break
            scratch.drop(now)
            now, cut = after, left
        whole, room = _settle(now, scratch, room, n)
        placed += whole
    single = marked.where("m = 1").withColumn("k", F.lit(0))
    single = dense_index(single, scratch, ["k"], "h", [F.col("h"), F.col("row")], "i", pieces(n))
    placed.append(single.select("row", _slot_of(F.col("i"), room).alias("shard")))
    shard = placed[0]
    for p in placed[1:]:
        shard = shard.unionByName(p)
    linked = meet_counted(base, counted.select("g", "n", F.lit(True).alias("linked")), ["g"], n, how="left")
    out = scratch.keep(linked.join(shard, "row"))
    out = out.withColumn("d", F.xxhash64("h", F.lit(1)))  # shards took rows by ranges and buckets of h
    out = dense_index(out, scratch, ["shard"], "d", [F.col("d"), F.col("row")], "slot", pieces(n // shards))
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", "slot", F.coalesce("linked", F.lit(False)).alias("linked"), "g")


def _shares(spark: SparkSession, groups: list[Row], given: list[list[tuple[int, int]]]) -> DataFrame:
    """For each group, its shards and where in a number within the group their places end."""
    rows = [(bytes(r.g), [s for s, _ in x], [sum(k for _, k in x[: i + 1]) for i in range(len(x))]) for r, x in zip(groups, given)]
    return spark.createDataFrame(rows, "g binary, __s array<int>, __e array<long>")


def _share_out(rows: DataFrame, shares: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """row and shard of the rows whose groups are in shares."""
    own = scratch.keep(rows.select("row", "h", "g").join(F.broadcast(shares.select("g")), "g", "left_semi"))
    own = dense_index(own, scratch, ["g"], "h", [F.col("h"), F.col("row")], "i", pieces(n)).join(F.broadcast(shares), "g")
    return own.select("row", F.element_at("__s", (F.size(F.filter("__e", lambda e: e <= F.col("i"))) + 1).cast("int")).alias("shard"))


def _cut(now: DataFrame) -> int:
    """Links from each group's shard of most members to its members elsewhere."""
    per = now.groupBy("g", "m", "s").agg(F.count(F.lit(1)).alias("c")).groupBy("g", "m").agg(F.max("c").alias("top"))
    return per.agg(F.coalesce(F.sum(F.col("m") - F.col("top")), F.lit(0)).cast("long")).first()[0]


def _flows(wishes: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many of wishes[s][t] may move so that no shard's arrivals exceed its free places and its leavers.

    Where a shard would overflow, its arrivals are cut in proportion; that keeps rows in the shards they come from, which
    may overflow in turn, until none does.
    """
    a = [row[:] for row in wishes]
    shards = range(len(free))
    over = [sum(a[s][t] for s in shards) - sum(a[t]) - free[t] for t in shards]
    while (most := max(over)) > 0:
        t = over.index(most)
        total = sum(a[s][t] for s in shards)
        seen = 0
        for s in shards:
            stay = (total - most) * (seen + a[s][t]) // total - (total - most) * seen // total
            seen += a[s][t]
            over[s] += a[s][t] - stay
            a[s][t] = stay
        over[t] -= most
    return a


def _propagate(now: DataFrame, scratch: Scratch, room: list[int], count: int) -> DataFrame:
    """One round: rows with their new shards."""
    loads = dict(now.groupBy("s").count().collect())  # a row per shard
    free = [r - loads.get(s, 0) for s, r in enumerate(room)]
    there = now.groupBy("g", "m", "s").agg(F.count(F.lit(1)).alias("c"))
    left = _longs(free)[F.col("s")]
    best = F.max(F.struct((left >= F.col("m") - F.col("c")).alias("fits"), "c", F.xxhash64("g", "s").alias("tie"), F.col("s").alias("t")))
    targets = scratch.keep(there.groupBy("g").agg(best.alias("b"), F.sum("c").alias("n")).select("g", "n", F.col("b.t").alias("t")))
    joined = scratch.keep(meet_counted(now, targets, ["g"], count).withColumn("hg", F.xxhash64("g")))
    wish = joined.where("s <> t")
    wishes = [[0] * len(room) for _ in room]
    for r in wish.groupBy("s", "t").agg(F.count(F.lit(1)).alias("c")).collect():  # a row per pair of shards
        wishes[r.s][r.t] = r.c
    flows = _flows(wishes, free)
    ranked = dense_index(wish, scratch, ["s", "t"], "hg", [F.col("hg"), F.col("g"), F.col("row")], "i", max(1, -(-count // (QUOTA_ROWS * len(room)))))  # groups go as a whole if they can
    may = F.array(*[_longs(x) for x in flows])[F.col("s")][F.col("t")]
    after = joined.where("s = t").select("row", "h", "g", "m", "s").unionByName(ranked.select("row", "h", "g", "m", F.when(F.col("i") < may, F.col("t")).otherwise(F.col("s")).alias("s")))
    after = scratch.keep(after)
    scratch.drop(targets, joined)
    return after


def _settle(now: DataFrame, scratch: Scratch, room: list[int], n: int) -> tuple[list[DataFrame], list[int]]:
    """row and shard of all rows, and the room left: groups that are whole stay, the others are placed anew."""
    shards = len(room)
    there = now.groupBy("g", "m", "s").agg(F.count(F.lit(1)).alias("c"))
    per = scratch.keep(there.groupBy("g", "m").agg((F.count(F.lit(1)) > 1).alias("loose"), F.min("s").alias("s")))
    taken = dict(per.where("NOT loose").groupBy("s").agg(F.sum("m")).collect())
    room = [r - taken.get(s, 0) for s, r in enumerate(room)]
    fates = [per.where("NOT loose").select("g", F.col("s").alias("shard"))]
    large = F.col("m") * PACKED * shards > n
    given = per.where("loose").where(large).orderBy(F.desc("m"), "g").limit(PACKED * shards).collect()  # fewer than PACKED * shards
    parts = _give_giants([r.m for r in given], room)
    small = per.where("loose").where(~large)
    if not small.isEmpty():
        d = scratch.keep(small.select("g", "m", F.pmod(F.xxhash64("g"), F.lit(pieces(n))).cast("int").alias("b"), F.lit(0).alias("k")))
        sums = d.groupBy("k", "b").agg(F.sum("m").alias("m"))
        before = sums.select("b", F.coalesce(F.sum("m").over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
        own = F.sum("m").over(W.partitionBy("b").orderBy("g").rowsBetween(W.unboundedPreceding, W.currentRow))
        ends = d.withColumn("own", own).join(bounded(scratch.keep(before)), "b").withColumn("end", F.col("at") + F.col("own"))
        dealt = scratch.keep(ends.select("g", "m", _slot_of(F.col("end") - F.col("m"), room).alias("shard"), _slot_of(F.col("end") - 1, room).alias("last")))
        inside = dealt.where("shard = last")
        fates.append(inside.select("g", "shard"))
        taken = dict(inside.groupBy("shard").agg(F.sum("m")).collect())
        room = [r - taken.get(s, 0) for s, r in enumerate(room)]
        across = dealt.where("shard <> last").orderBy(F.desc("m"), "g").limit(shards).collect()  # one per bound between shards at most
        given, parts = given + across, parts + _give_giants([r.m for r in across], room)
    one = [(bytes(r.g), x[0][0]) for r, x in zip(given, parts) if len(x) == 1]
    split = [(r, x) for r, x in zip(given, parts) if len(x) > 1]
    if one:
        fates.append(now.sparkSession.createDataFrame(one, "g binary, shard int"))
    fate = fates[0]
    for f in fates[1:]:
        fate = fate.unionByName(f)
    fate = scratch.keep(fate.join(per.select("g", F.col("m").alias("n")), "g"))
    out = [meet_counted(now, fate, ["g"], n).select("row", "shard")]
    if split:
        out.append(_share_out(now, _shares(now.sparkSession, [r for r, _ in split], [x for _, x in split]), scratch, n))
    return out, room


def cut_edges(assigned: DataFrame) -> DataFrame:
    """One row: links from each text's shard of most copies to its copies elsewhere (cut), of all such links."""
    per = assigned.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.sum("c").alias("m"), F.max("c").alias("top"))
    return per.agg(F.coalesce(F.sum(F.col("m") - F.col("top")), F.lit(0)).alias("cut"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("links"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")

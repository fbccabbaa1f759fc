"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each document becomes a short vector of statistics of its whole text. Random Fourier features of the vector
approximate a Gaussian kernel. Every task sums the outer products of its training rows; the sums have a fixed
size and are added in a tree. Calibration pools adjacent violators over counts in BINS bins of the ridge score of
labelled rows that the ridge wasn't fitted on (one fold of four; where it lacks a label, all labelled rows).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, tune

#: Random features, kernel width in standard deviations of a statistic, ridge penalty, seed, calibration bins.
FEATURES, WIDTH, RIDGE, SEED, BINS = 192, 4.0, 0.1, 7, 1024
#: Sums added in one task.
FAN_IN = 32
#: A document counts as good from this score on.
THRESHOLD = 0.3
#: Remainder of crc32(doc_id) by 5 of the labelled rows that calibrate (0 is held out).
CALIBRATED = 1

_CLASSES = np.zeros((256, 8), np.float64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:?'\"-()", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~")):
    _CLASSES[list(_chars), _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """Of a whole text; null and empty texts have zeros."""
    data = (text or "").encode()
    if not data:
        return np.zeros(20)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    shares = counts @ _CLASSES / n
    other = counts[128:].sum() / n
    words = data.split()
    w = max(1, len(words))
    freq = Counter(words)
    top = sum(c for _, c in freq.most_common(3)) / w
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines) / k
    entropy = -sum(p * np.log2(p) for p in counts[counts > 0] / n)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return np.array([*shares, other, np.log1p(n), np.log1p(w), np.log1p(k), lengths.mean(), lengths.std(), len(freq) / w, top, len(set(lines)) / k, np.log1p(n / k), ended, entropy])


class Kernel:
    """Standardised statistics to random Fourier features."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([np.ones((len(x), 1)), x / 10, z])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the rows to learn from; of repeated ids the smallest label counts, null ids and labels don't."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    return y


def _add_up(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """Sum of the arrays in rows (part long, data binary), in a tree."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float64) for d in rows.data)
        return pd.DataFrame({"part": [int(rows.part.iloc[0])], "data": [total.tobytes()]})

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(add, "part long, data binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    rows = parts.collect()  # one
    return sum(np.frombuffer(r.data, np.float64) for r in rows) if rows else None


def pool(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic means of bins; empty bins take the value of the bin before them (the first: of the first filled)."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(counts):
        blocks.append([sums[i], counts[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
    out = np.zeros(len(sums))
    for at, (s, c, i) in enumerate(blocks):
        out[0 if at == 0 else i :] = s / c
    return out


def stats_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, x array<double>: statistics of each row's whole text."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score double in 0 to 1 (estimated share of label 1 among such documents).

    All labelled rows that aren't held out are learnt from; without any the score is 0.5. Null and empty texts
    have a score like others; repeated rows and null ids give a row each; of an id that is repeated in docs each row
    is learnt from. Only id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(stats_of(docs, id_col, text_col))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == CALIBRATED
    every = scratch.keep(stats.join(labelled(labels, label), "doc_id").select("x", "y", fold.alias("apart")))
    per = {r.apart: r for r in every.groupBy("apart").agg(F.min("y").alias("low"), F.max("y").alias("high")).collect()}
    split = len(per) == 2 and all(r.low < r.high for r in per.values())
    train, check = (every.where("NOT apart"), every.where("apart")) if split else (every, every)
    train, check = train.select("x", "y"), check.select("x", "y")
    width = len(statistics(None))
    moments = train.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    kind = stats.schema["doc_id"].dataType.simpleString()
    if moments[0] is None:
        return stats.select(F.col("doc_id").alias(id_col), F.lit(0.5).alias("score"))
    kernel = Kernel(np.array(moments[:width]), np.array(moments[width:]))
    size = 1 + width + FEATURES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                z = kernel(_matrix(b.column(0)))
                total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    parts = train.mapInArrow(sums, "data binary").withColumn("part", F.spark_partition_id().cast("long"))
    total = _add_up(parts, train.rdd.getNumPartitions()).reshape(size, size + 1)
    weights = np.linalg.solve(total[:, :size] + RIDGE * np.eye(size), total[:, size])

    def ridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = kernel(_matrix(b.column(1))) @ weights if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r, pa.float64())], names=["doc_id", "r"])

    def bin_of(r: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((r + 0.5) / 2 * BINS))).cast("int")

    fitted = check.select("y", "x").mapInArrow(ridge, "doc_id double, r double").select(F.col("doc_id").alias("y"), "r")
    binned = fitted.groupBy(bin_of(F.col("r")).alias("bin")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c")).collect()  # BINS at most
    s, c = np.zeros(BINS), np.zeros(BINS)
    for row in binned:
        s[row.bin], c[row.bin] = row.s, row.c
    steps = F.array(*[F.lit(float(v)) for v in pool(s, c)])
    # within a step the ridge score breaks ties, by less than a step's height matters
    fine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("r") + 0.5) / 2))
    scored = stats.select("doc_id", "x").mapInArrow(ridge, f"doc_id {kind}, r double")
    return scored.select(F.col("doc_id").alias(id_col), (F.element_at(steps, bin_of(F.col("r")) + 1) * 0.999 + fine * 0.001).alias("score"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

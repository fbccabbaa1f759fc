"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches.

A pre-token is a run of spaces with the characters up to the next space: no piece of the model goes on from
another character into a space, so pieces never cross a pre-token's start, and its length in tokens doesn't
depend on what stands around it. No pre-token is ever shuffled, nor leaves its worker: each task sums up its
documents' pre-tokens in a Misra-Gries summary of fixed size and sends the 128-bit hashes of what is left, with
counts and lengths, three arrays of numbers. These are merged in a tree over all documents, and the table of
lengths by hash that is broadcast has FREQUENT entries at most, whatever the input. A pre-token that a worker
meets for the first time is looked up there, and only what the table lacks is encoded. The counting is a first
pass over all texts. That two of some 10^12 pre-tokens share a hash of 128 bits has a chance below 10^-14.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, tune

#: Entries of the broadcast table, and counters of a summary.
FREQUENT = 8192
#: Bytes of a worker's cache, a pre-token counted as its characters and WORD_BYTES; it starts anew beyond it.
CACHE_BYTES, WORD_BYTES = 48 << 20, 150
#: Summaries merged in one task.
FAN_IN = 16

_SPACED = re.compile(" +[^ ]*").findall


def pre_tokens(text: str) -> list[str]:
    """Of a text that isn't empty; each without the one space that stands before it (the first: that would)."""
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _SPACED(" " + text)]
    return text.split(" ")


def trimmed(counts: Counter, size: int) -> Counter:
    """Misra-Gries: with more than size counters, all go down by the count that the one after the last kept has."""
    if len(counts) <= size:
        return counts
    off = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - off for w, n in counts.items() if n > off})


def hash_of(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode())


def frequent(docs: DataFrame, text_col: str, path: str, size: int = FREQUENT) -> dict[bytes, int]:
    """Hash: length of at most size pre-tokens: all those that are more than one in size + 1 of all pre-tokens are among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    counts.update(pre_tokens(text))
            if len(counts) > 16 * size:
                counts = trimmed(counts, size)
        counts = trimmed(counts, size)
        lengths = held(("token counts", path), lambda: Lengths(path)).of(counts)
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(map(hash_of, counts))], pa.binary()), pa.array([list(counts.values())], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=["hashes", "counts", "lengths"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        length: dict[bytes, int] = {}
        for h, ns, ls in zip(parts.hashes, parts.counts, parts.lengths):
            own = [h[i : i + 16] for i in range(0, len(h), 16)]
            counts.update(dict(zip(own, map(int, ns))))
            length.update(zip(own, map(int, ls)))
        counts = trimmed(counts, size)
        return pd.DataFrame({"hashes": [b"".join(counts)], "counts": [list(counts.values())], "lengths": [[length[h] for h in counts]], "part": [int(parts.part.iloc[0])]})

    schema = "hashes binary, counts array<long>, lengths array<long>"
    texts = docs.select(F.col(text_col).alias("text"))
    tasks = texts.rdd.getNumPartitions()
    parts = texts.mapInArrow(count, schema).withColumn("part", F.spark_partition_id().cast("long"))
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = parts.groupBy("part").applyInPandas(merge, f"{schema}, part long")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    return {bytes(r.hashes[i : i + 16]): n for r in parts.collect() for i, n in zip(range(0, len(r.hashes), 16), r.lengths)}  # one summary


class Lengths(dict):
    """Pre-token: its number of tokens. Misses of a batch that the table lacks too are encoded together."""

    def __init__(self, path: str, table: dict[bytes, int] | None = None):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = table or {}
        self.bytes = self.encoded = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        size = sum(map(len, new)) + WORD_BYTES * len(new)
        if self.bytes + size > CACHE_BYTES and len(self):
            self.clear()
            self.bytes = 0
            self.learn(words)
            return
        self.bytes += size
        rest = []
        for w in new:
            n = self.table.get(hash_of(w))
            if n is None:
                rest.append(w)
            else:
                self[w] = n
        self.encoded += len(rest)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            self.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        if "" in words:
            self[""] = 1  # a single space before the end

    def of(self, words: Iterable[str]) -> list[int]:
        self.learn(set(words))
        return [self[w] for w in words]

    def count(self, texts: list[str | None]) -> list[int]:
        split = [pre_tokens(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [sum(map(self.__getitem__, words)) for words in split]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = FREQUENT) -> DataFrame:
    """id_col, n_bytes long (UTF-8), n_tokens long of each row's whole text.

    A null or empty text has 0 of both. Each row gives one row; repeated rows and null ids repeat; an empty table
    gives none. Other columns, whatever their names, are neither read nor returned. The model at path must be
    readable on every executor.
    """
    tune(docs.sparkSession)
    known = frequent(docs, text_col, path, size)  # goes along with the function: Spark broadcasts it
    key = "token counts", path, xxhash.xxh3_64_hexdigest(b"".join(sorted(known)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = held(key, lambda: Lengths(path, known))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths.count(b.column(2).to_pylist()), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    columns = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return columns.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


#: A document of more tokens is over the limit.
LIMIT = 4096


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)

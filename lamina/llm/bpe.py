"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens that a batch of documents adds are laid out as one run of symbols. An inverted index
maps each token pair to the positions where it stands; merges are then applied once each, in rank order, to
all positions of their pair, and only the two neighbours of a merged pair enter the index anew. Encodings are
kept in a bounded cache of the worker, so that a pre-token is replayed once, not once per occurrence.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, tune

#: Bytes of a worker's cache of encoded pre-tokens, a pre-token counted as its characters and WORD_BYTES; it starts anew beyond it.
CACHE_BYTES, WORD_BYTES = 48 << 20, 200
#: Characters of text whose new pre-tokens are replayed together (a longer text goes alone).
REPLAY_CHARS = 6_000_000
#: Rank of a pair that doesn't merge.
NONE = 2**31 - 1


class MergeReplay:
    """Encodes batches of distinct pre-tokens by replaying every merge over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, np.int64) for x in zip(*splits)) if splits else (np.zeros(0, np.int64),) * 3
        n = len(self.tokens)
        by_left, by_right = np.lexsort((b, a)), np.lexsort((a, b))
        #: For a token as the left (right) part: where its partners stand, the partners in order, the merged ranks.
        self.left = np.searchsorted(a[by_left], np.arange(n + 1)), b[by_left], r[by_left]
        self.right = np.searchsorted(b[by_right], np.arange(n + 1)), a[by_right], r[by_right]
        self.base = self._rank_pairs(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def _rank_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        starts, partners, merged = self.left
        get = {(int(x), int(partners[i])): int(merged[i]) for x in np.unique(a) for i in range(starts[x], starts[x + 1])}
        return np.array([get.get(p, NONE) for p in zip(a.tolist(), b.tolist())], np.int32)

    @staticmethod
    def _ranks_with(side: tuple, token: int, others: np.ndarray) -> np.ndarray | None:
        """Ranks of token with each of others, NONE where they don't merge; None if token merges with nothing."""
        starts, partners, merged = side
        lo, hi = starts[token], starts[token + 1]
        if lo == hi:
            return None
        at = np.minimum(np.searchsorted(partners[lo:hi], others), hi - lo - 1) + lo
        return np.where(partners[at] == others, merged[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of ids of each word."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        n = len(flat) + len(words)  # a gap of -1 after each word
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = self.byte[flat]
        starts = ends - sizes
        symbols[np.repeat(starts[whole >= 0], sizes[whole >= 0]) + _ramp(sizes[whole >= 0])] = -2
        symbols[starts[whole >= 0]] = whole[whole >= 0]

        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n + 1, NONE, np.int32)  # rank of the pair that begins at a position
        loose = inside.copy()  # positions whose symbols merges may take
        loose[np.repeat(starts[whole >= 0], sizes[whole >= 0]) + _ramp(sizes[whole >= 0])] = False
        first = np.flatnonzero(loose[:-1] & loose[1:])
        spread = np.full(n, -1, np.int16)
        spread[inside] = flat
        pair[first] = self.base[spread[first].astype(np.int32) * 256 + spread[first + 1]]
        first = first[pair[first] < NONE]
        order = first[np.argsort(pair[first], kind="stable")]
        ranked, at = np.unique(pair[order], return_index=True)
        cut = [*at.tolist(), len(order)]
        index: dict[int, list[np.ndarray]] = {r: [order[cut[i] : cut[i + 1]]] for i, r in enumerate(ranked.tolist())}
        heap = ranked.tolist()  # in order, so it is a heap
        odd: list[np.ndarray] = []

        def enter(places: np.ndarray, new: np.ndarray, rank: int) -> None:
            pair[places] = new
            if len(low := places[new < rank]):
                odd.append(low)
            good = new < NONE
            places, new = places[good], new[good]
            if not len(places):
                return
            if len(places) > 1:
                by = np.argsort(new, kind="stable")
                places, new = places[by], new[by]
            edges = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
            for lo, hi in zip(edges, edges[1:]):
                r = int(new[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[lo:hi])

        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            p = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            p = p[pair[p] == rank]  # a neighbour may have changed since
            if not len(p):
                continue
            q = after[p]
            if len(p) > 1:
                if (p[1:] == p[:-1]).any():
                    p = np.unique(p)
                    q = after[p]
                chained = q[:-1] == p[1:]
                if chained.any():  # overlapping places: every second one from the left
                    run = np.arange(len(p))
                    begin = np.maximum.accumulate(np.where(np.r_[True, ~chained], run, 0))
                    take = (run - begin) % 2 == 0
                    p, q = p[take], q[take]
            z = after[q]
            touching = np.flatnonzero(z[:-1] == p[1:])
            if len(touching):  # the left one goes first, and may make a pair of lower rank with the other's left part
                new = self._ranks_with(self.left, rank, symbols[p[1:][touching]])
                if new is not None and (new < rank).any():
                    odd.append(p[touching[new < rank]])
            symbols[p] = rank
            symbols[q] = -2
            pair[q] = NONE
            after[p] = z
            before[np.minimum(z, n - 1)] = p
            new = self._ranks_with(self.left, rank, symbols[z])  # z is the gap at the latest
            if new is None:
                pair[p] = NONE
            else:
                enter(p, new, rank)
            o = before[p]
            o = o[o >= 0]
            o = o[symbols[o] >= 0]
            if len(o):
                o = o[loose[o]]
                new = self._ranks_with(self.right, rank, symbols[o])
                if new is None:
                    pair[o] = NONE
                else:  # o may be one of p, merged itself just now; its pair is then (rank, rank) either way
                    enter(o, new, rank)

        kept = symbols != -2
        counts = np.diff(np.r_[0, np.cumsum(kept)[ends]]) - 1
        ids = symbols[kept & inside]
        if odd:  # a merge made a pair of lower rank, which goes before the word's other merges
            which = np.unique(np.searchsorted(ends, np.concatenate(odd)))
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for w in which.tolist():
                lists[w] = np.array(self.encode_one(words[w]), np.int32)
                counts[w] = len(lists[w])
            ids = np.concatenate(lists)
        return ids, counts

    def encode_one(self, word: bytes) -> list[int]:
        """The definition: the pair of lowest rank is merged, the leftmost first, until none is left."""
        parts = [bytes([b]) for b in word]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found or len(parts) == 1:
                return [self.ranks[x] for x in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def read_ranks(path: str) -> dict[bytes, int]:
    """token: rank of a .tiktoken file, whose lines are a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Codec:
    """Of one worker: pattern, vocabulary and the cache of encoded pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()  # of cached pre-tokens
        self.bytes = 0
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)  # of each pre-token in ids

    def numbers(self, text: str) -> np.ndarray:
        """Of the text's pre-tokens; new ones get the next numbers, and learn() encodes them."""
        words = self.find(text)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        new = [w.encode() for w in islice(self.number, len(self.start) - 1, None)]
        if new:
            self.bytes += sum(map(len, new)) + WORD_BYTES * len(new)
            ids, counts = self.replay.encode(new)
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.bytes > CACHE_BYTES:
            self.clear()
        split = [self.numbers(t or "") for t in texts]
        self.learn()
        return [self.ids_of(x) for x in split]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.start[numbers]
        sizes = self.start[numbers + 1] - starts
        return self.ids[np.repeat(starts, sizes) + _ramp(sizes)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids.tolist()))


def _codec(path: str, pattern: str) -> Codec:
    """Workers are used again: the vocabulary is read and the cache filled once for many tasks."""
    return held(("byte-level bpe", path, pattern), lambda: Codec(path, pattern))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together that have REPLAY_CHARS of text."""
    group: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if group and size + b.nbytes > REPLAY_CHARS:
            yield group
            group, size = [], 0
        group.append(b)
        size += b.nbytes
    if group:
        yield group


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<i4")]), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids array<int> of each row's whole text; with decoded, the bytes that the ids give too.

    The vocabulary file at path must be readable on every executor. A null or empty text has no ids. Each row
    gives one row: repeated rows and null ids repeat. Other columns are neither read nor returned.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for group in _gathered(batches):
            split = []
            if codec.bytes > CACHE_BYTES:
                codec.clear()
            for b in group:
                split.append((b.column(0), [codec.numbers(t or "") for t in b.column(1).to_pylist()]))
            group.clear()
            codec.learn()
            for keys, numbers in split:
                ids = [codec.ids_of(x) for x in numbers]
                cols = [keys, pa.array([len(x) for x in ids], pa.int64()), _lists(ids)]
                names = ["id", "n_tokens", "ids"]
                if decoded:
                    cols.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, n_tokens long, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded binary: the bytes of each row's ids (null or none: no bytes); unknown ids raise IndexError."""
    tune(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, r"\s+")
        for b in batches:
            got = [codec.decode(np.array(x or [], "<i4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "decoded"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of what encode(decoded=True) returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(id_col, "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[str, str]:
    """Production parameters: the file of ranks and the pre-token pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), *vocabulary(), decoded=True))

"""Packing into fixed-length sequences by cutting-stock column generation.

Each document's ids (and a closing id 0) are cut into whole sequences and one remainder. The remainders' length
histogram is the demand of a cutting-stock linear program whose columns are patterns of lengths that fit one sequence:
a revised simplex prices new patterns by an unbounded-knapsack dynamic program until the Farley bound shows the
solution within GAP of the optimum. Pattern counts are rounded down, what is left is packed best fit decreasing, and the patterns' slots are
dealt to the documents ranked within their length. Histogram and plan are bounded by the sequence length,
whatever the number of documents.

Edge cases: a null or empty text is the closing id alone. Rows with null or repeated ids are packed like any other,
each row on its own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut, shuffle_partitions
from .common import blocks, tidy

LENGTH = 1024
#: Relative gap between the linear program's value and its bound at which column generation stops.
GAP = 5e-4
#: Weight of the wasteless prices in pricing.
SMOOTHING = 0.5
#: Word pieces whose ids a worker remembers.
REMEMBERED = 300_000

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_cache: dict = {}


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's keys."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of word pieces; a piece not yet seen is encoded when asked for."""

    #: White space around which a cut at a space would change the pieces.
    tangled = re.compile(r"\s \s|\s \Z|\x00")

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x[k] for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        names = byte_names()
        ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        #: Added tokens stand for themselves wherever their text occurs; the parts between are encoded each on its own.
        self.added = {x: np.array([i], dtype="<u4").tobytes() for x, i in added.items() if x}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def of(vocabulary: str) -> Encoder:
        if vocabulary not in _cache:
            _cache[vocabulary] = Encoder(vocabulary)
        return _cache[vocabulary]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.encode(piece), dtype="<u4").tobytes()
        if len(piece) < 40:
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        """The ids of the whole text, equal to those of the vocabulary's own tokenizer.

        The text is cut before each space, where a piece of the pattern begins anyway; texts where that does not
        hold are encoded in one go.
        """
        if not text:
            return b""
        if any(x in text for x in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.between.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if self.tangled.search(text):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of the pieces each row's document is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for whole in batches:
            for batch in blocks(whole):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encoder.ids(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        part = ids[4 * at : 4 * (at + length)]
                        rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
                columns = list(zip(*rows, strict=True)) if rows else [()] * (5 + with_ids)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a pattern, and how often it has each size."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        k = upto[c]
        worth = best[c - sizes[:k]] + values[:k]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], chosen[c] = worth[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= int(sizes[chosen[c]])
    return float(best[capacity]), pattern


def descending(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns filled with the largest sizes still in demand, each used until it exhausts one size.

    The pattern that exhausts a size is that size's row. No later pattern holds the size, so the rows are independent.
    """
    m = len(sizes)
    columns, used, left = np.zeros((m, m), dtype=np.int64), np.zeros(m), demand.astype(np.float64).copy()
    open_sizes = list(range(m))
    while open_sizes:
        pattern, room, top = {}, capacity, len(open_sizes)
        while room >= sizes[open_sizes[0]]:
            top = bisect.bisect_right(open_sizes, room, 0, top, key=lambda i: sizes[i])
            if not top:
                break
            i = open_sizes[top - 1]
            n = int(min(room // sizes[i], max(1, left[i])))
            pattern[i] = n
            room -= n * int(sizes[i])
            top -= 1
            if not top:
                break
        times, gone = min((left[i] / n, i) for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= n * times
            columns[gone, i] = n
        left[gone], used[gone] = 0, times
        open_sizes.remove(gone)
    return columns, used


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractional, by column generation."""
    columns, used = descending(sizes, demand, capacity)
    inverse = np.linalg.inv(columns.T.astype(np.float64))
    # prices are drawn towards those of a solution without waste, which steadies their course
    ideal, weight = sizes / capacity, SMOOTHING
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        total = used.sum()
        if total <= (1 + gap) * (demand @ sizes / capacity):
            break
        _, pattern = knapsack(sizes, weight * ideal + (1 - weight) * prices, capacity)
        if pattern @ prices <= 1 + 1e-9:
            value, pattern = knapsack(sizes, prices, capacity)
            if value <= 1 + 1e-9 or total <= (1 + gap) * total / value:
                break
        some = np.flatnonzero(pattern)
        step = inverse[:, some] @ pattern[some]
        ok = step > 1e-9
        ratio = np.where(ok, used / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        used = np.maximum(used - move * step, 0)
        used[out] = move
        row = inverse[out] / step[out]
        step[out] = 0
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = pattern
    return columns, used


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Patterns, one for each sequence, for what rounding left over."""
    room: list[tuple[int, int]] = []
    out: list[dict[int, int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(counts[i])):
            at = bisect.bisect_left(room, (int(sizes[i]), -1))
            left, k = room.pop(at) if at < len(room) else (capacity, len(out))
            if k == len(out):
                out.append({})
            out[k][i] = out[k].get(i, 0) + 1
            bisect.insort(room, (left - int(sizes[i]), k))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots, as (length, first rank, sequence, copies in it, offset), and the number of sequences."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return [], 0
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.float64)
    columns, used = linear_program(sizes, demand, capacity)
    left = demand.astype(np.int64)
    made: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-used, kind="stable").tolist():
        some = np.flatnonzero(columns[k])
        times = int(min(np.floor(used[k] + 1e-7), (left[some] // columns[k][some]).min()))
        if times:
            left[some] -= times * columns[k][some]
            made.append(({i: int(columns[k][i]) for i in some.tolist()}, times))
    made += [(p, 1) for p in best_fit(sizes, left, capacity)]
    slots, base, ranks = [], 0, np.zeros(len(sizes), dtype=np.int64)
    for pattern, times in made:
        offset = 0
        for i in sorted(pattern, reverse=True):
            slots.append((int(sizes[i]), int(ranks[i]), base, pattern[i], offset))
            ranks[i] += times * pattern[i]
            offset += pattern[i] * int(sizes[i])
        base += times
    return slots, base


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; no sequence holds more than ``length`` ids."""
    if length > 1 << 14:
        raise ValueError("the plan is made for sequences of at most 16384 ids")
    cut_up = cut(pieces(docs, vocabulary, length, with_ids))
    rest = cut_up.where(F.col("length") < length)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, sequences = plan(histogram, length)
    whole = cut_up.where(F.col("length") == length).select("*", (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not slots:
        return whole
    # ranks within a length: within its salted parts, plus the sizes of the parts before
    salted = rest.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_partitions(docs.sparkSession))))
    sums = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    table = sorted(slots)
    span = 1 << 44
    keys = np.array([s * span + r for s, r, *_ in table], dtype=np.int64)
    first, base, copies, offset = (np.array([x[k] for x in table], dtype=np.int64) for k in (1, 2, 3, 4))
    names = cut_up.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, size * span + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(base[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * size)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{n} {t}" for n, t in cut_up.dtypes) + ", sequence_id long, offset long"
    return whole.union(ranked.select(*names, "rank").mapInArrow(tidy(deal), schema))

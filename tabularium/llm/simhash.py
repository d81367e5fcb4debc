"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints: 3-word shingles of the A-Z lower-cased text, XXH64 (seed 42) of each, and a bit set where
more than half of the hashes have it. Documents link at ``radius`` or fewer differing bits.

Equal fingerprints are merged first, so copies cost nothing. Distinct fingerprints meet in a task for each
pair of 16-bit blocks on which they agree (of four blocks two at least agree within a distance of 2), so each
link is seen by some task. A task sorts its fingerprints by Gray rank and builds a tree over runs of that
order: a node keeps the bits common to all below it that its ancestors have not; a query adds the
differences on those bits on its way down and drops whole groups beyond the radius. Only a spanning forest of the links
found leaves the task.

Edge cases: null text is an empty text; a text without words has fingerprint zero and links like any other;
fewer than 3 words make one shingle. Rows of equal text get equal fingerprints, rows of one id each get a row. A null
id takes part in no link and gets no component. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut
from .common import LOWER, as_bytes, blocks, tidy

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Children of a tree node, and most (query, node) pairs held at once.
FAN, FRONTIER = 8, 1 << 20
#: Pairs of the four 16-bit blocks.
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1][: n - shingle + 1].tolist()
        ends = ends[shingle - 1 :].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                fps = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the prefix parity of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The tree over distinct fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        ones = [self.fps.copy()]
        zeros = [~self.fps]
        while len(ones[-1]) > 1:
            at = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], at))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], at))
        self.bits, self.masks = ones, []
        for k, (o, z) in enumerate(zip(ones, zeros, strict=True)):
            common = o | z
            if k + 1 < len(ones):
                common = common & ~(ones[k + 1] | zeros[k + 1])[np.arange(len(o)) // FAN]
            self.masks.append(common)

    def within(self, lo: int, hi: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j of fingerprints within the radius, for i in lo..hi-1, in parts."""
        top = len(self.bits) - 1
        q = np.arange(lo, hi)
        stack = [(top, q, np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int8))]
        while stack:
            level, q, node, far = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], far[:half]), (level, q[half:], node[half:], far[half:])]
                continue
            far = far + np.bitwise_count((self.fps[q] ^ self.bits[level][node]) & self.masks[level][node]).astype(np.int8)
            near = far <= radius
            q, node, far = q[near], node[near], far[near]
            if not len(q):
                continue
            if level == 0:
                later = node > q
                if later.any():
                    yield q[later], node[later]
                continue
            child = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
            q, far = np.repeat(q, FAN), np.repeat(far, FAN)
            # a link is found from its earlier end only
            ok = (child < len(self.bits[level - 1])) & ((child + 1) * FAN ** (level - 1) > q)
            stack.append((level - 1, q[ok], child[ok], far[ok]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the links that join two trees."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                a_out.append(x)
                b_out.append(y)
    return np.array(a_out, dtype=np.int64), np.array(b_out, dtype=np.int64)


def links_of(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints at the two ends of a spanning forest of the links among distinct ``fps``."""
    index = GrayIndex(fps)
    n = len(index.fps)
    a, b = forest(n, (x for lo in range(0, n, 4096) for x in index.within(lo, min(n, lo + 4096), radius)))
    return index.fps[a], index.fps[b]


def link(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: a spanning forest, by task, of the links among distinct fingerprints (column ``fp``)."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to 2 differing bits")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*[F.lit(i).cast("long") * (1 << 32) + block[a] * 65536 + block[b] for i, (a, b) in enumerate(PAIRS)])
    dealt = distinct.select("fp", F.explode(keys).alias("key")).repartition("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        shared = np.unique(fp[counts[inverse] > 1].view(np.uint64))
        a, b = links_of(shared, radius)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    prints = cut(fingerprints(docs))
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = cut(link(classes.select("fp"), radius).distinct())
    found = connected_components(edges, "a", "b")
    # the least id of a component, from the least ids of its fingerprints
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the class of every row."""
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of the documents that come first in their component; a row without an id stays."""
    gone = components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")

"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and every run of what is neither letter nor digit becomes a space. A benchmark item is cut into
overlapping windows (a short item is one window). Within ``budget`` edits a window of n characters keeps at least
n - Q + 1 - Q * budget of its q-grams, all on diagonals that differ by no more than the budget. So the q-grams
that a document shares with the windows are counted in overlapping diagonal bands, each q-gram of a window once; bands that reach the bound are
verified by a banded alignment of the window with the document.

Items with fewer than LEAST characters after the clean-up have too few q-grams for that; an automaton finds where their words
stand exactly.

The benchmark is sent to the tasks in blocks of about BLOCK_CHARS characters, one pass over the documents for each block, whose result is
stored before the next block is fetched; so neither a task nor the driver holds more than a block. The shared q-grams of a
document are counted by stretches of STRETCH characters and by ranges of windows, so repeated q-grams take bounded memory.

A part of a longer item is found if it holds one of the item's windows: any part of 143 characters does, a shorter one only if it
covers one.

Edge cases: null or empty texts and items match nothing; repeated items and documents each get rows; rows with null ids are matched too, with a null in the
result, but a document without an id isn't removed. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import blocks, tidy

Q = 12
#: Characters of a window, steps between windows, characters for each edit of the budget, and the shortest item.
WINDOW, STRIDE, CHARS_PER_EDIT, LEAST = 96, 48, 16, 32
#: Characters of benchmark text in a pass.
BLOCK_CHARS = 4_000_000
#: Characters of a document, and shared q-grams, that are counted at once.
STRETCH, AT_ONCE = 1 << 16, 4_000_000
#: Slots of the bitmap that most of a document's q-grams are dismissed by.
SLOTS = 22

_cache: dict = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

Row = tuple[int | None, int, int, int, int]


#: ASCII characters that are neither letters nor digits, as spaces.
_SPACES = {i: " " for i in range(128) if not chr(i).isalnum()}


def clean(text: str | None) -> str:
    """Lower-case words joined by single spaces."""
    low = (text or "").lower().translate(_SPACES)
    odd = {ord(c): " " for c in set(low) if not c.isalnum() and c != " "}
    return " ".join((low.translate(odd) if odd else low).split())


def grams(points: np.ndarray) -> np.ndarray:
    """A hash of each of the q-grams of a row of code points."""
    h, have, out, done = points.astype(np.uint64), 1, None, 0
    power = int(_BASE)
    rest = Q
    while True:
        if rest & 1:
            if out is None:
                out, done = h, have
            else:
                n = len(out) - have
                out = out[:n] * np.uint64(power) + h[done : done + n]
                done += have
        rest >>= 1
        if not rest:
            break
        h = h[: len(h) - have] * np.uint64(power) + h[have:]
        power = power * power % (1 << 64)
        have *= 2
    out = out * _MIX
    return out ^ (out >> np.uint64(29))


class Index:
    """The q-grams of a block of items and the windows that hold them."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = items
        self.windows: list[tuple[int, int, str, int, int]] = []  # item, start, text, budget, bound
        codes, window, at = [], [], []
        short: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(items):
            n = len(text)
            if n < LEAST:
                if text:
                    short.setdefault(f" {text} ", []).append(k)
                continue
            starts = [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]
            for s in starts:
                part = text[s : s + WINDOW]
                budget = min(len(part) // CHARS_PER_EDIT, (len(part) - Q) // (Q + 1))
                g = grams(points(part))
                window.append(np.full(len(g), len(self.windows), dtype=np.int64))
                at.append(np.arange(len(g)))
                codes.append(g)
                self.windows.append((k, s, part, budget, len(part) - Q + 1 - Q * budget))
        empty = np.zeros(0, dtype=np.int64)
        codes, window, at = np.concatenate([empty.view(np.uint64), *codes]), np.concatenate([empty, *window]), np.concatenate([empty, *at])
        order = np.argsort(codes, kind="stable")
        self.window, self.at = window[order], at[order]
        self.codes, slot = np.unique(codes[order], return_inverse=True)
        # by q-gram, and within a q-gram by window
        self.entries = slot * (len(self.windows) + 1) + self.window
        self.bitmap = np.zeros(1 << SLOTS, dtype=bool)
        self.bitmap[(self.codes >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
        self.budget = np.array([w[3] for w in self.windows], dtype=np.int64)
        self.bound = np.array([w[4] for w in self.windows], dtype=np.int64)
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for phrase, found in short.items():
                self.short.add_word(phrase, (len(phrase), found))
            self.short.make_automaton()

    @staticmethod
    def of(items: list[tuple[int | None, str]]) -> Index:
        key = hashlib.sha256(repr(items).encode()).hexdigest()
        if key not in _cache:
            _cache.clear()
            _cache[key] = Index(items)
        return _cache[key]

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands in which a row of q-grams reaches the bound."""
        hit = np.flatnonzero(self.bitmap[(codes >> np.uint64(64 - SLOTS)).astype(np.int64)])
        if not len(hit) or not len(self.codes):
            return hit[:0], hit[:0]
        slot = np.searchsorted(self.codes, codes[hit])
        slot[slot == len(self.codes)] = 0
        same = self.codes[slot] == codes[hit]
        return self.count(hit[same], slot[same], 0, len(self.windows))

    def count(self, hit: np.ndarray, slot: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Those bands of the windows from ``lo`` to ``hi``, for q-grams ``slot`` at places ``hit``."""
        first = np.searchsorted(self.entries, slot * (len(self.windows) + 1) + lo)
        count = np.searchsorted(self.entries, slot * (len(self.windows) + 1) + hi) - first
        some = count > 0
        hit, slot, first, count = hit[some], slot[some], first[some], count[some]
        total = int(count.sum())
        if total > AT_ONCE and hi - lo > 1:
            mid = (lo + hi) // 2
            return tuple(np.concatenate(x) for x in zip(self.count(hit, slot, lo, mid), self.count(hit, slot, mid, hi), strict=True))
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
        window, at = self.window[entry], self.at[entry]
        diagonal = np.repeat(hit, count) - at + WINDOW
        # a band is twice a step wide, and a step is wider than the budget, so a match lies within one band
        step = self.budget[window] + 1
        band = diagonal // step
        window, at, band = np.r_[window, window], np.r_[at, at], np.r_[band, band - 1]
        low = window << 42
        key = np.unique(np.stack([low + (band + 1), at], axis=1).view([("k", np.int64), ("a", np.int64)]).reshape(-1))["k"]
        key, counts = np.unique(key, return_counts=True)
        window, band = key >> 42, (key & ((1 << 42) - 1)) - 1
        good = counts >= self.bound[window]
        window, band = window[good], band[good]
        return window, band * (self.budget[window] + 1) - WINDOW


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def align(window: np.ndarray, text: np.ndarray, lo: int, width: int, budget: int) -> tuple[int, int] | None:
    """Least edits between the window and a stretch of the text, and the stretch's end; None beyond the budget.

    Only cells on the diagonals lo - budget to lo + width + budget are filled. The stretch may begin anywhere on them.
    """
    first, cells = lo - budget, width + 2 * budget + 1
    big = np.int64(1 << 30)
    ramp = np.arange(cells)
    j = first + ramp
    row = np.where((j >= 0) & (j <= len(text)), 0, big)
    for i, c in enumerate(window.tolist()):
        j = first + i + ramp  # the text's characters used before this row's step
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(cells, dtype=bool)
        same[inside] = text[j[inside]] == c
        new = np.where(inside, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - ramp) + ramp
        row = np.where((j + 1 >= 0) & (j + 1 <= len(text)), new, big)
        if row.min() > budget:
            return None
    best = int(row.argmin())
    return int(row[best]), first + len(window) + best


def matches(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text its (item, windows matched, least edits, start, end), places in the cleaned text."""
    cleaned = [clean(t) for t in texts]
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    if index.short is not None:
        for d, text in enumerate(cleaned):
            hits: dict[int, list[int]] = {}
            for end, (n, items) in index.short.iter(f" {text} "):
                for k in items:
                    hits.setdefault(k, []).append(end - n + 1)
                    hits[k][1:] = [end - 1]
            out[d] += [(k, 1, 0, at[0], at[-1]) for k, at in sorted(hits.items())]
    flat = points("\n".join(cleaned))
    if len(flat) < Q:
        return out
    codes = grams(flat)
    begins = np.cumsum([0, *[len(t) + 1 for t in cleaned]])
    # texts that share no window's worth of q-grams are done
    hit = np.flatnonzero(index.bitmap[(codes >> np.uint64(64 - SLOTS)).astype(np.int64)])
    per = np.bincount(np.searchsorted(begins, hit, side="right") - 1, minlength=len(texts))
    least = int(index.bound.min()) if len(index.bound) else 1 << 60
    for d in np.flatnonzero(per[: len(texts)] >= least).tolist():
        text = flat[begins[d] : begins[d + 1] - 1]
        own = codes[begins[d] : max(begins[d], begins[d + 1] - Q)]
        # stretches overlap by more than a window with its edits
        parts = [(s, index.bands(own[s : s + STRETCH + 2 * WINDOW])) for s in range(0, len(own), STRETCH)]
        windows, diagonals = np.concatenate([w for _, (w, _) in parts]), np.concatenate([x + s for s, (_, x) in parts])
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for w, lo in zip(windows.tolist(), diagonals.tolist(), strict=True):
            item, _, part, budget, _ = index.windows[w]
            if found.get(item, {}).get(w, (1,))[0] == 0:
                continue
            got = align(points(part), text, lo, 2 * budget + 1, budget)
            if got and got[0] <= budget and got[0] < found.get(item, {}).get(w, (1 << 30,))[0]:
                found.setdefault(item, {})[w] = (got[0], max(0, got[1] - len(part)), got[1])
        for item, by in sorted(found.items()):
            out[d].append((item, len(by), min(x[0] for x in by.values()), min(x[1] for x in by.values()), max(x[2] for x in by.values())))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The cleaned items, in blocks of a bounded size, and whether there are several; each is fetched when its pass is due."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_CHARS)
    for p in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield [(r["item_id"], clean(r["text"])) for r in mine.orderBy("item_id", "text").collect()], parts > 1


SCHEMA = "doc_id long, item_id long, windows long, edits long, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, windows, edits, start, end`` for each document and item of which it holds a window.

    start and end are places in the cleaned text, edits the least of the windows found.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, several = None, False
    for items, several in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index.of(items)
            for whole in batches:
                for batch in blocks(whole):
                    rows = []
                    for doc, hits in zip(batch.column("doc_id").to_pylist(), matches(index, batch.column("text").to_pylist()), strict=True):
                        rows += [(doc, items[i][0], *rest) for i, *rest in hits]
                    columns = zip(*rows, strict=True) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        found = chosen.mapInArrow(tidy(run), SCHEMA)
        if several:
            found = cut(found)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no benchmark passage, with all their columns."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")

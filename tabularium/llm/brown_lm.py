"""Language-model scoring by Brown class-based bigrams.

The training documents' word counts and bigram counts cover the whole corpus. Exchange clustering assigns the MERGED most frequent words
to CLASSES classes, moving each word to the class that raises the bigram likelihood most. Every other word of the KNOWN most
frequent ones then goes to the class that raises it most, by a distributed pass over its own counts next to the classes. Words beyond
that table, and words that never occurred, belong to one of ENDINGS classes by their last two bytes, and a text's end is a class of its own (a text begins
after one). A text's probability is that of its class transitions times that of each word given its class, both with additive
smoothing.

The KNOWN most frequent words, a bounded table that is filled in order of count and then of the word, are looked up in the scoring tasks; the
counts of all others are joined on, so the vocabulary may be of any size.

Edge cases: null and empty texts are the end alone. Without training documents every count is 0 and all probabilities come from
the smoothing. Rows with one id, or none, are scored each on its own; a null id is held out of nothing (its fold is null) and not learned from. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import LOWER, as_bytes, blocks, fold

MERGED, CLASSES, ENDINGS, KNOWN, SWEEPS = 800, 40, 40, 50_000, 4
ALPHA = 0.1
#: Words counted in a task before they are passed on.
HELD = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def ending(word: bytes) -> int:
    """The class, within ENDINGS, of a word beyond the table."""
    return zlib.crc32(word[-2:]) % ENDINGS


def _training(docs: DataFrame, folds: int) -> DataFrame:
    return docs.select("doc_id", "text").where(fold("doc_id", folds) != 0).select("text")


def word_counts(train: DataFrame) -> DataFrame:
    """``word, c``: how often each word occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

        for whole in batches:
            for batch in blocks(whole):
                for text in as_bytes(batch.column("text")):
                    held.update(words_of(text))
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def code_pairs(train: DataFrame, place: dict[bytes, int], n: int, other: bool) -> np.ndarray:
    """Counts of neighbouring codes, an n by n table; a word's code is that in ``place``, others' by ending (``other``) or none.

    n is bounded by MERGED or by the number of classes, so the table is too.
    """
    variable = train.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = variable.value, np.zeros(n * n, dtype=np.int64)
        for whole in batches:
            for batch in blocks(whole):
                for text in as_bytes(batch.column("text")):
                    words = words_of(text)
                    if other:
                        row = _classes(words, codes, n)
                        pairs = row[:-1] * n + row[1:]
                    else:
                        row = np.fromiter(map(codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                        good = (row[:-1] >= 0) & (row[1:] >= 0)
                        pairs = (row[:-1] * n + row[1:])[good]
                    np.add.at(total, pairs, 1) if len(pairs) < 64 else _add(total, pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(n * n, dtype=np.int64)
    table[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return table.reshape(n, n)


def _add(total: np.ndarray, places: np.ndarray) -> None:
    values, counts = np.unique(places, return_counts=True)
    total[values] += counts


def _classes(words: list[bytes], codes: dict[bytes, int], n: int) -> np.ndarray:
    """Classes of the end before, the words and the end behind; n - 1 is the end's."""
    row = np.empty(len(words) + 2, dtype=np.int64)
    row[0] = row[-1] = n - 1
    row[1:-1] = np.fromiter(map(codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    for i in np.flatnonzero(row < 0).tolist():
        row[i] = n - 1 - ENDINGS + ending(words[i - 1])
    return row


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word, from the words' bigram counts; words come in order of frequency.

    The likelihood is sum N(a,b) log N(a,b) - sum N(a.) log N(a.) - sum N(.b) log N(.b) over classes; each move takes
    the class that makes it greatest.
    """
    m = len(bigrams)
    k = min(classes, m)
    of = np.arange(m) % max(k, 1)
    if k < 2:
        return of
    b = bigrams.astype(np.float64)
    member = np.zeros((m, k))
    member[np.arange(m), of] = 1
    n = member.T @ b @ member
    right, left = b @ member, member.T @ b  # word to class, class to word

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            own, c, loop = of[w], None, b[w, w]
            r, s = right[w].copy(), left[:, w].copy()
            r[own] -= loop  # without the word's own pair, which moves along
            s[own] -= loop
            n[own] -= r
            n[:, own] -= s
            n[own, own] -= loop
            rows, cols = n.sum(axis=1) + s, n.sum(axis=0) + r  # the word's neighbours keep their totals
            gain = f(n + r).sum(axis=1) - f(n).sum(axis=1)
            gain += f(n + s[:, None]).sum(axis=0) - f(n).sum(axis=0)
            d = np.diag(n)
            gain += f(d + r + s + loop) - f(d + r) - f(d + s) + f(d)
            gain -= f(rows + r.sum() + loop) - f(rows) + f(cols + s.sum() + loop) - f(cols)
            c = int(gain.argmax())
            if gain[c] <= gain[own] + 1e-9:
                c = own
            n[c] += r
            n[:, c] += s
            n[c, c] += loop
            if c != own:
                of[w] = c
                moved += 1
                right[:, own] -= b[:, w]
                right[:, c] += b[:, w]
                left[own] -= b[w]
                left[c] += b[w]
        if not moved:
            break
    return of


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words and their counts, by falling count, then by word.

    A histogram over eighths of octaves gives the levels that fit as a whole; of the next one only the first words in order are
    fetched, so no more than ``most`` words reach the driver, however many partitions hold the counts.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    total, lowest, partial = 0, None, None
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["l"]):
        if total + r["n"] > most:
            partial = r["l"]
            break
        total += r["n"]
        lowest = r["l"]
    rows = [] if lowest is None else counts.where(level >= lowest).collect()
    if partial is not None and total < most:
        rows += counts.where(level == partial).orderBy(F.desc("c"), "word").limit(most - total).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def assign(train: DataFrame, top: list[tuple[bytes, int]], found: np.ndarray, classes: int) -> dict[bytes, int]:
    """A class for every word of the table; ``found`` has those of the first.

    Two codes follow the classes': of a word without a class, and of a text's end. Cell d of a word counts how often code d comes after it, cell
    classes + 2 + d how often before it; the cells are bounded by the table's size times that of the codes.
    """
    n, m = classes + 2, len(found)
    place = {w: i for i, (w, _) in enumerate(top)}
    of = np.full(len(top) + 1, classes, dtype=np.int64)  # the last is for words that are not in the table
    of[:m] = found
    variable = train.sparkSession.sparkContext.broadcast((place, of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, of = variable.value
        beyond = len(of) - 1
        for whole in batches:
            for batch in blocks(whole):
                cells = []
                for text in as_bytes(batch.column("text")):
                    words = words_of(text)
                    row = np.fromiter(map(place.get, words, repeat(beyond)), dtype=np.int64, count=len(words))
                    code = np.r_[n - 1, of[row], n - 1]
                    # the codes' own pairs are rows behind the words'
                    cells.append(np.concatenate([row * 2 * n + code[2:], row * 2 * n + n + code[:-2], (beyond + 1 + code[:-1]) * 2 * n + code[1:]]))
                cell, times = np.unique(np.concatenate(cells), return_counts=True)
                ok = cell // (2 * n) != beyond
                yield pa.RecordBatch.from_arrays([pa.array(cell[ok] // (2 * n), pa.int32()), pa.array(cell[ok] % (2 * n), pa.int32()), pa.array(times[ok])], ["word", "cell", "n"])

    cells = cut(train.mapInArrow(count, "word int, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n")))
    between = np.zeros((n, n))
    for r in cells.where(F.col("word") > len(top)).collect():
        between[r["word"] - len(top) - 1, r["cell"]] = r["n"]

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        t = pa.concat_tables(parts)
        word, inverse = np.unique(t.column("word").to_numpy(), return_inverse=True)
        for lo in range(0, len(word), 4096):
            some = (inverse >= lo) & (inverse < lo + 4096)
            own = np.zeros((min(4096, len(word) - lo), 2 * n))
            own[inverse[some] - lo, t.column("cell").to_numpy()[some]] = t.column("n").to_numpy()[some]
            after, before = own[:, :n], own[:, n:]
            gain = np.empty((len(own), classes))
            for c in range(classes):
                row, col = between[c], between[:, c]
                gain[:, c] = (f(row + after) - f(row)).sum(axis=1) + (f(col + before) - f(col)).sum(axis=1)
                gain[:, c] -= f(row.sum() + after.sum(axis=1)) - f(row.sum()) + f(col.sum() + before.sum(axis=1)) - f(col.sum())
            yield pa.RecordBatch.from_arrays([pa.array(word[lo : lo + 4096], pa.int32()), pa.array(gain.argmax(axis=1).astype(np.int32))], ["word", "class"])

    if len(top) > m:
        rest = cells.where((F.col("word") >= m) & (F.col("word") < len(top))).repartition("word").mapInArrow(choose, "word int, class int").toArrow()
        of[rest.column("word").to_numpy()] = rest.column("class").to_numpy()
    return {w: int(of[i]) for w, i in place.items()}


class Model:
    """What the scoring tasks need; its size is bounded by KNOWN and the number of classes."""

    def __init__(self, tokens: int, distinct: int, top: list[tuple[bytes, int]], of: dict[bytes, int], pairs: np.ndarray, sizes: np.ndarray, kinds: np.ndarray):
        self.tokens = tokens
        self.floor = np.log10(tokens + 0.1 * (distinct + 1))
        self.n = len(pairs)
        self.place = {w: i for i, (w, _) in enumerate(top)}
        count = np.array([c for _, c in top], dtype=np.float64)
        self.classes = np.array([of[w] for w, _ in top], dtype=np.int64)
        self.logs = np.log10(count + ALPHA)
        self.ends = np.log10(pairs[:, -1].sum() + ALPHA)
        self.known_end = pairs[:, -1].sum() > 0
        smooth = pairs + 0.5
        self.move = np.log10(smooth / smooth.sum(axis=1, keepdims=True))
        self.total = np.log10(sizes + ALPHA * (kinds + 1))

    def score(self, text: bytes | None) -> tuple[int, int, float, float, Counter]:
        """Tokens, known ones, base and class scores as far as the table goes, and the words that are not in it."""
        words = words_of(text)
        row = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        there = row >= 0
        classes = np.full(len(words) + 2, self.n - 1, dtype=np.int64)
        inner = classes[1:-1]
        inner[there] = self.classes[row[there]]
        rest: Counter = Counter()
        for i in np.flatnonzero(~there).tolist():
            w = words[i]
            rest[w] += 1
            inner[i] = self.n - 1 - ENDINGS + ending(w)
        seen = self.logs[row[there]].sum() + self.ends
        n = len(words) + 1
        score = self.move[classes[:-1], classes[1:]].sum() + seen - self.total[inner].sum() - self.total[-1]
        return n, int(there.sum()) + int(self.known_end), float(seen - n * self.floor), float(score), rest


def learn(docs: DataFrame, folds: int = 10) -> tuple[Model, DataFrame]:
    """The model and the stored counts of all words."""
    train = _training(docs, folds)
    counts = cut(word_counts(train))
    texts = train.count()
    tail = F.pmod(F.crc32(F.when(F.length("word") > 2, F.expr("substring(word, -2, 2)")).otherwise(F.col("word"))), F.lit(ENDINGS)).alias("e")
    top = most_frequent(counts, KNOWN)
    merged = [w for w, _ in top[:MERGED]]
    bigrams = code_pairs(train, {w: i for i, w in enumerate(merged)}, max(1, len(merged)), False)
    classes = min(CLASSES, max(1, len(merged)))
    found = exchange(bigrams, classes) if merged else np.zeros(0, dtype=np.int64)
    of = assign(train, top, found, classes) if merged else {}
    n = classes + ENDINGS + 1
    pairs = code_pairs(train, of, n, True)
    sizes, kinds = np.zeros(n), np.zeros(n)
    for r in counts.groupBy(tail).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        sizes[classes + r["e"]], kinds[classes + r["e"]] = r["c"], r["k"]
    tokens = int(sizes.sum()) + texts
    distinct = int(kinds.sum()) + (texts > 0)
    for w, c in top:
        for table, x in ((sizes, c), (kinds, 1)):
            table[of[w]] += x
            table[classes + ending(w)] -= x
    sizes[-1], kinds[-1] = texts, 1
    return Model(tokens, distinct, top, of, pairs, sizes, kinds), counts


def score_all(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    variable = docs.sparkSession.sparkContext.broadcast(model)
    schema = "key long, doc_id long, word binary, n long, tokens long, known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = variable.value
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for whole in batches:
            for batch in blocks(whole):
                rows: list[tuple] = []
                for key, doc, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                    tokens, known, base, score, rest = m.score(text)
                    # the row of the text itself has a word that none can be, of a space and the key
                    rows.append((key, doc, b" %d" % key, 0, tokens, known, base, score))
                    rows += [(key, doc, w, n, 0, 0, 0.0, 0.0) for w, n in rest.items()]
                columns = zip(*rows, strict=True) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = keyed.mapInArrow(run, schema)
    # the words of the table were looked up already
    known = F.col("c").isNotNull()
    rare = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ALPHA))
    joined = parts.join(counts, "word", "left")
    sums = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(known, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(rare)).alias("base_score"),
        (F.sum("score") + F.sum(rare)).alias("score"),
    )
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

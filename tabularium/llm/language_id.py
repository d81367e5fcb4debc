"""Language identification by cross-parsing entropy.

A suffix automaton is built for each language from a bounded sample of labelled text: SAMPLE_CHARS characters, taken in equal shares from
up to SAMPLE_DOCS documents, each share from a place of the whole text drawn by a hash. A text, of any length, is
parsed greedily into the longest phrases that occur in that sample; the language that needs the fewest phrases for the text's
length wins. Every letter of the samples, whatever the script, has a code of its own; a letter that no sample holds is a phrase
in each language, and whatever is no letter counts as a space.

Edge cases: a null text, an empty one and one without a letter get ``und`` and score 0. Rows with a
null ``lang`` or null id are never learned from. Ties go to the alphabetically first language. Without
any labelled row everything is ``und``. Repeated rows get the same answer; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, fold, tidy

#: Characters of training text for each language, and the most documents read for it.
SAMPLE_CHARS, SAMPLE_DOCS = 24_000, 48
#: The letters, by frequency in the samples, whose moves are in a dense table; those of others are searched.
DENSE = 60
#: Texts are parsed in pieces of this many characters, all pieces of a block in step, until each begins as the one before it ends.
PIECE = 256
#: Bytes of text in a block, for which a worker holds some 50 times as much.
TEXT_BYTES = 1 << 19
#: Codes: of letters outside the alphabet, of whatever is no letter, of padding, between sampled documents.
UNKNOWN, SPACE, PAD, BREAK = 0, 1, 2, 3
#: What stands between sampled stretches, and the factor of the state in a searched move's key.
BETWEEN, WIDE = "\n\0\n", 1 << 21
#: Phrases a character beyond which a text resembles none of the languages.
REJECT_RATE = 0.62

_cache: dict = {}


def sample(docs: DataFrame, held_out_folds: int = 5) -> dict[str, str]:
    """Text to learn from, for each language: at most SAMPLE_DOCS documents of the training folds, the least by hash."""
    known = docs.select("doc_id", "text", "lang").where(
        (fold("doc_id", held_out_folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 40))
    bound, share = F.lit(0), F.lit(0)
    for lang, n in sorted(counts.items()):
        mine = F.col("lang") == lang
        bound = F.when(mine, F.lit(int(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 40)))).otherwise(bound)
        share = F.when(mine, F.lit(max(200, SAMPLE_CHARS // min(n, SAMPLE_DOCS)))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - share + 1, F.lit(1))).cast("int") + 1
    rows = (
        known.select("lang", draw.alias("d"), F.substring("text", place, share).alias("text"))
        .where(F.col("d") < bound)
        .orderBy("d", "text")
        .limit(4 * SAMPLE_DOCS * len(counts))
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in rows:
        mine = out.setdefault(r["lang"], [])
        if len(mine) < SAMPLE_DOCS:
            mine.append(r["text"])
    return {lang: BETWEEN.join(texts) for lang, texts in out.items()}


def unicode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point, and whether it is a letter, for every code point."""
    if "unicode" not in _cache:
        n = 0x110000
        lower = np.arange(n, dtype=np.uint32)
        letter = np.zeros(n, dtype=bool)
        for i in range(n):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                if len(x := c.lower()) == 1:
                    lower[i] = ord(x)
        _cache["unicode"] = lower, letter
    return _cache["unicode"]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def automaton(codes: list[int], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves of the suffix automaton of ``codes``: those of codes below ``letters`` flat, at state * letters + code, others as sorted keys and values.

    A value of 0 or more is the next state times ``letters``. Where the phrase can't grow it is the
    complement of the state that a new phrase beginning with that code reaches. A key is state * WIDE + code.
    """
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    # the last state follows a code that the language hasn't, and a text's start: whatever comes next begins a phrase
    dead = len(move) * letters
    fresh = np.array([~(move[0][c] * letters if c in move[0] else dead) for c in range(letters)], dtype=np.int32)
    flat = np.tile(fresh, (len(move) + 1, 1))
    searched: list[tuple[int, int]] = []
    for s, ways in enumerate(move):
        for c, to in ways.items():
            if c < letters:
                flat[s, c] = to * letters
            else:
                searched.append((s * WIDE + c, to * letters))
    flat[:, UNKNOWN] = ~dead
    flat[:, PAD] = dead
    keys, values = np.array(sorted(searched), dtype=np.int64).reshape(-1, 2).T
    return np.ascontiguousarray(flat.reshape(-1)), np.ascontiguousarray(keys), values.astype(np.int32)


class Model:
    """The automata of all languages and the coding of characters."""

    def __init__(self, texts: dict[str, str]):
        lower, letter = unicode_tables()
        self.langs = sorted(texts)
        found = np.concatenate([lower[points(texts[x])] for x in self.langs])
        found = found[letter[found]]
        values, counts = np.unique(found, return_counts=True)
        chosen = values[np.lexsort((values, -counts))]
        self.size = BREAK + 1 + min(DENSE, len(chosen))
        own = np.zeros(0x110000, dtype=np.int32)
        own[chosen] = np.arange(BREAK + 1, BREAK + 1 + len(chosen), dtype=np.int32)
        self.code = np.where(letter, own[lower], SPACE).astype(np.int32)
        self.letter = letter
        self.moves = []
        for lang in self.langs:
            codes: list[int] = []
            for part in texts[lang].split(BETWEEN):
                x = self.code[points(part)]
                x = x[(x != SPACE) | (np.r_[np.int32(SPACE), x[:-1]] != SPACE)]
                codes += [*x.tolist(), BREAK]
            self.moves.append(automaton(codes, self.size))

    @staticmethod
    def of(texts: dict[str, str]) -> Model:
        key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
        # a reused worker keeps the last model only
        if _cache.get("key") != key:
            _cache.pop("model", None)
            _cache["model"], _cache["key"] = Model(texts), key
        return _cache["model"]

    def parse(self, language: int, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each column of codes, from the given states on, and the states at the end."""
        moves, keys, values = self.moves[language]
        begin = len(moves) - self.size
        phrases = np.zeros(len(state), dtype=np.int32)
        rare = steps >= self.size
        often = np.where(rare, UNKNOWN, steps) if rare.any() else steps
        for codes, plain, odd in zip(steps, often, rare.any(axis=1).tolist(), strict=True):
            to = moves.take(state + plain)
            if odd:
                at = np.flatnonzero(codes >= self.size)
                grown = self.search(keys, values, (state[at] // self.size).astype(np.int64) * WIDE + codes[at])
                fresh = self.search(keys, values, codes[at].astype(np.int64))
                to[at] = np.where(grown >= 0, grown, ~np.where(fresh >= 0, fresh, begin))
            new = to >> 31
            phrases -= new
            state = to ^ new
        return phrases, state

    @staticmethod
    def search(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.int32(-1))

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a character by language, and whether there is a letter, for each text."""
        n = len(texts)
        lens = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
        flat = points("".join(t for t in texts if t))
        owner = np.repeat(np.arange(n), lens)
        has = np.bincount(owner[self.letter[flat]], minlength=n) > 0
        x = self.code[flat]
        keep = (x != SPACE) | (np.r_[np.int32(SPACE), x[:-1]] != SPACE) | (np.r_[-1, owner[:-1]] != owner)
        x, owner = x[keep], owner[keep]
        lens = np.bincount(owner, minlength=n)
        begins = np.cumsum(lens) - lens
        pieces = -(-lens // PIECE)
        which = np.repeat(np.arange(n), pieces)
        grid = np.full((len(which), PIECE), PAD, dtype=np.int32)
        place = np.arange(len(x)) - begins[owner]
        row = (np.cumsum(pieces) - pieces)[owner] + place // PIECE
        grid[row, place % PIECE] = x
        del place, row, owner, flat
        steps = np.ascontiguousarray(grid.T)
        first = np.r_[-1, which[:-1]] != which
        out = np.zeros((n, len(self.langs)))
        for j, (moves, _, _) in enumerate(self.moves):
            begin = np.int32(len(moves) - self.size)
            entry = np.full(len(which), begin, dtype=np.int32)
            phrases, end = self.parse(j, steps, entry)
            while True:
                # a piece goes on in the state in which the one before it ends
                due = np.where(first, begin, np.r_[begin, end[:-1]])
                late = np.flatnonzero(due != entry)
                if not len(late):
                    break
                entry[late] = due[late]
                phrases[late], end[late] = self.parse(j, steps[:, late], entry[late])
            out[:, j] = np.bincount(which, weights=phrases, minlength=n)
        return out / np.maximum(lens, 1)[:, None], has


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and phrases a character of each text."""
    rate, has = model.rates(texts)
    best = np.argmin(rate, axis=1) if len(texts) else np.zeros(0, dtype=int)
    least = rate[np.arange(len(texts)), best]
    if len(model.langs) > 1:
        second = np.partition(rate, 1, axis=1)[:, 1]
        score = second / np.maximum(least + second, 1e-12)
    else:
        score = np.ones(len(texts))
    langs = [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
    return langs, np.where(has, np.clip(score, 0, 1), 0.0), np.where(has, least, 1.0)


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``doc_id, lang_pred, score, phrase_rate`` of every row, by the samples in ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(texts) if texts else None
        for whole in batches:
            for batch in blocks(whole, size=TEXT_BYTES):
                if model is None:
                    n = batch.num_rows
                    langs, score, rate = ["und"] * n, np.zeros(n), np.ones(n)
                else:
                    langs, score, rate = decide(model, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                    ["doc_id", "lang_pred", "score", "phrase_rate"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, phrase_rate double")


def keep_identified(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the learned languages.

    Rejected are texts without a letter and texts that need more than REJECT_RATE phrases a character
    in every language.
    """
    if not texts:
        return docs.limit(0)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(texts)
        for whole in batches:
            for batch in blocks(pa.RecordBatch.from_arrays(whole.columns, [f"c{i}" for i in range(len(names))]), f"c{at}", TEXT_BYTES):
                langs, _, rate = decide(model, batch.column(at).to_pylist())
                good = pa.array([x != "und" and r <= REJECT_RATE for x, r in zip(langs, rate.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(batch.filter(good).columns, names)

    return docs.mapInArrow(tidy(run), docs.schema)

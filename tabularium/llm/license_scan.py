"""Licence scans: Aho-Corasick over words for notices, a shunting-yard parser for tagged expressions.

One pass of the automaton over a text's words finds the base phrases, further notice phrases and the tag words
``spdx license identifier``. The expression behind a tag is parsed with the precedence WITH, AND, OR and evaluated: the
licences it names become labels, its permissiveness is the least of an AND and the greatest of an OR.

Edge cases: null text is empty; no notice and no tag give null first and last words, empty labels and score 0; an expression
that can't be parsed adds the label ``unparsed`` and score 0. Phrases overlap freely and every place counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, blocks

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices that the method labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely a work under a label can be used, by the label's beginning; the longest beginning counts, others have OTHER.
PERMISSIVE = {
    "cc0": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "0bsd": 1.0, "unlicense": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5,
    "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
OTHER = 0.4

#: A-Z to a-z, and every ASCII character but letters and digits to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_tagged = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_token = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_cache: dict = {}


def automaton() -> ahocorasick.Automaton:
    if "it" not in _cache:
        it = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            it.add_word(f" {phrase} ", phrase)
        it.make_automaton()
        _cache["it"] = it
    return _cache["it"]


def permissiveness(label: str) -> float:
    fits = [x for x in PERMISSIVE if label == x or label.startswith((x + "-", x + "."))]
    return PERMISSIVE[max(fits, key=len)] if fits else OTHER


def parse(expression: str) -> tuple[list, int]:
    """The expression's operands and operators in postfix order, and how many tokens it takes up.

    It ends where the tokens no longer continue it. Raises ValueError if nothing, or only a part, can be parsed.
    """
    rank = {"with": 3, "and": 2, "or": 1}
    out: list = []
    held: list[str] = []
    want, taken = True, 0
    for token in _token.findall(expression):
        low = token.lower()
        if want:
            if low == "(":
                held.append("(")
            elif low in rank or low == ")":
                raise ValueError(f"an operand is missing before {token}")
            else:
                out.append(low)
                want = False
        elif low == ")":
            while held and held[-1] != "(":
                out.append((held.pop(),))
            if not held:
                break
            held.pop()
        elif low in rank:
            while held and held[-1] != "(" and rank[held[-1]] >= rank[low]:
                out.append((held.pop(),))
            held.append(low)
            want = True
        else:
            break
        taken += 1
    if want or "(" in held:
        raise ValueError("the expression is not complete")
    return out + [(x,) for x in reversed(held)], taken


def evaluate(postfix: list) -> tuple[set[str], float]:
    """The licences that a parsed expression names, and its permissiveness."""
    stack: list[tuple[set[str], float, str]] = []
    for x in postfix:
        if isinstance(x, str):
            stack.append(({x}, permissiveness(x), x))
            continue
        b, a = stack.pop(), stack.pop()
        if x[0] == "with":
            # an exception loosens its licence: half of what is missing
            stack.append(({f"{n}-with-{b[2]}" for n in a[0]}, a[1] + (1 - a[1]) / 2, a[2]))
        else:
            stack.append((a[0] | b[0], (min if x[0] == "and" else max)(a[1], b[1]), a[2]))
    return stack[0][0], stack[0][1]


def scan(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    words = (text or b"").translate(WORDS).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    tagged = False
    at = nth = 0  # words before the place up to which they are counted
    for end, phrase in sorted(automaton().iter(joined), key=lambda x: x[0] - len(x[1])):
        if phrase in BASE:
            begin = end - len(phrase) - 1
            nth += joined.count(" ", at, begin)
            at = begin
            places.append(nth)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            more.add(NOTICES[phrase])
    scores = [permissiveness(x) for x in (more or base)]
    if tagged:
        for found in _tagged.finditer((text or b"").decode("utf-8", "replace")):
            try:
                names, score = evaluate(parse(found[1])[0])
            except ValueError:
                names, score = {"unparsed"}, 0.0
            more |= names
            scores.append(score)
    labels = ",".join(sorted(base | more))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), labels, min(scores, default=0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_all(docs: DataFrame) -> DataFrame:
    """The scan of every row. score: permissiveness of what the row's notices and tags grant together, 0 for none."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                columns = zip(*map(scan, as_bytes(batch.column("text"))), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [x.split()[0] for x in SCHEMA.split(", ")]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

"""Neighbour queries in two and three dimensions, by cells as wide as the search radius."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .graph import connected_components


def _delta(a: Column, b: Column, box: float | None) -> Column:
    d = F.abs(a - b)
    return d if box is None else F.least(F.pmod(d, F.lit(box)), F.lit(box) - F.pmod(d, F.lit(box)))


def distance(a: Sequence[Column], b: Sequence[Column], box: Sequence[float] | None = None) -> Column:
    """Euclidean distance, in a periodic box if one is given."""
    parts = [_delta(x, y, box[i] if box else None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return F.sqrt(reduce(Column.__add__, [p * p for p in parts]))


def ball(df: DataFrame, axes: Sequence[str], centre: Sequence[float], radius: float, inner: float = 0.0, box: Sequence[float] | None = None, to: str = "distance") -> DataFrame:
    """Rows with inner <= distance <= radius; a box of bounds is tested first, which scans can use to skip row groups."""
    out = df
    if box is None:
        for a, c in zip(axes, centre, strict=True):
            out = out.where(F.col(a).between(c - radius, c + radius))
    d = distance([F.col(a) for a in axes], [F.lit(float(c)) for c in centre], box)
    return out.withColumn(to, d).where(F.col(to).between(inner, radius))


def segment(df: DataFrame, axes: Sequence[str], start: Sequence[float], end: Sequence[float], radius: float, capped: bool = True, to: str = "distance") -> DataFrame:
    """Rows within a radius of a line segment; a flat-ended cylinder if not ``capped``."""
    u = [b - a for a, b in zip(start, end, strict=True)]
    norm = sum(x * x for x in u)
    dot = reduce(Column.__add__, [(F.col(a) - s) * x for a, s, x in zip(axes, start, u, strict=True)]) / norm
    t = F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))
    near = distance([F.col(a) for a in axes], [F.lit(float(s)) + t * x for s, x in zip(start, u, strict=True)])
    out = df.withColumn(to, near).where(F.col(to) <= radius)
    return out if capped else out.where(dot.between(0, 1))


def cone(df: DataFrame, axes: Sequence[str], apex: Sequence[float], direction: Sequence[float], half_angle: float, length: float) -> DataFrame:
    """Rows within a length of the apex and a half angle (degrees) of the direction."""
    norm = math.sqrt(sum(x * x for x in direction))
    v = [F.col(a) - c for a, c in zip(axes, apex, strict=True)]
    d = F.sqrt(reduce(Column.__add__, [x * x for x in v]))
    along = reduce(Column.__add__, [x * (y / norm) for x, y in zip(v, direction, strict=True)])
    return df.where((d <= length) & (along >= d * math.cos(math.radians(half_angle))))


def _cells(axes: Sequence[str], width: float, box: Sequence[float] | None) -> tuple[list[Column], list[int] | None]:
    counts = [max(1, int(b // width)) for b in box] if box else None
    cells = []
    for i, a in enumerate(axes):
        if counts:
            cells.append(F.least(F.floor(F.pmod(F.col(a), F.lit(box[i])) * counts[i] / box[i]), F.lit(counts[i] - 1)).cast("long"))
        else:
            cells.append(F.floor(F.col(a) / width).cast("long"))
    return cells, counts


def _finite(axes: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).isNotNull() & (F.abs(F.col(a)) < F.lit(float("inf"))) for a in axes])


def _met(left: DataFrame, right: DataFrame, left_id: str, right_id: str, axes: Sequence[str], radius: float, box: Sequence[float] | None, once: bool = False, keep: str | None = None) -> DataFrame:
    """``a, b, distance`` of the rows within the radius, with both rows' ``keep`` as ``x, y``.

    With ``once``, of one table without a box, only half of the cells around are met and a pair comes once, whichever row is a. Rows are dealt
    by their id before they are copied, so that a small file isn't one task; the join is no broadcast, because no estimate knows of the copies.
    """
    cells, counts = _cells(axes, radius, box)
    keys = [f"c{i}" for i in range(len(axes))]
    wide = [not counts or counts[i] >= 3 for i in range(len(axes))]
    around = list(itertools.product(*[(-1, 0, 1) if w else range(counts[i]) for i, w in enumerate(wide)]))
    if once:
        around = [s for s in around if s >= (0,) * len(axes)]
    kept = lambda to: [F.col(keep).alias(to)] if keep else []
    side = lambda df, name, to, own, at: df.where(_finite(axes)).select(F.col(name).alias(to), *[F.col(x).alias(f"__{at}{i}") for i, x in enumerate(axes)], *kept(own), *[c.alias(k) for k, c in zip(keys, cells, strict=True)])
    a = side(left, left_id, "a", "x", "l").repartition("a").withColumn("__step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in around])))
    moved = [F.col(k) + F.col("__step")[i] for i, k in enumerate(keys)]
    if counts:
        moved = [F.pmod(m, F.lit(counts[i])) if wide[i] else F.col("__step")[i].cast("long") for i, m in enumerate(moved)]
    a = a.withColumns(dict(zip(keys, moved, strict=True))).withColumn("__own", F.forall("__step", lambda s: s == 0)).drop("__step")
    met = a.join(side(right, right_id, "b", "y", "r").hint("merge"), keys)
    if once:
        met = met.where(~F.col("__own") | (F.col("a") < F.col("b")))
    d = distance([F.col(f"__l{i}") for i in range(len(axes))], [F.col(f"__r{i}") for i in range(len(axes))], box)
    return met.withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance", *(["x", "y"] if keep else []))


def cross_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, axes: Sequence[str], radius: float, box: Sequence[float] | None = None) -> DataFrame:
    """``a, b, distance`` of all left and right rows within the radius.

    Only the left side is copied to its neighbouring cells; both meet by an equality of cells, which is split if a cell is crowded.
    """
    return _met(left, right, left_id, right_id, axes, radius, box)


def pairs(df: DataFrame, row: str, axes: Sequence[str], radius: float, box: Sequence[float] | None = None, directed: bool = False, keep: str | None = None) -> DataFrame:
    """All pairs within the radius: once with a < b, or both ways; with each row's ``keep`` as ``x, y`` if one is named."""
    if directed or box:
        found = _met(df, df, row, row, axes, radius, box, keep=keep)
        return found.where("a != b") if directed else found.where("a < b")
    found = _met(df, df, row, row, axes, radius, box, once=True, keep=keep).where("a != b")
    own = [F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in ("xy", "yx")] if keep else []
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", *own)


#: How the linking lengths of two rows make the pair's, and the most that this is, as a factor of the greatest length.
COMBINE = {"max": (F.greatest, 1), "min": (F.least, 1), "mean": (lambda a, b: (a + b) / 2, 1), "sum": (lambda a, b: a + b, 2)}


def _longest(df: DataFrame, lengths: Sequence[str | float], combine: str) -> list[float]:
    """The most that each pair's length can be; 0 without rows."""
    if combine not in COMBINE:
        raise ValueError("combine is one of " + ", ".join(COMBINE))
    named = [x for x in lengths if isinstance(x, str)]
    row = df.agg(F.count(F.lit(1)), *[F.max(x) for x in named]).first()
    most = dict(zip(named, row[1:], strict=True))
    return [COMBINE[combine][1] * float(most[x] or 0) if isinstance(x, str) else float(x) for x in lengths]


def linked_pairs(df: DataFrame, row: str, axes: Sequence[str], length: str, combine: str = "max", box: Sequence[float] | None = None) -> DataFrame:
    """``a, b, distance`` with a < b of the pairs within the length that their rows' own lengths make.

    A cell is as wide as the longest, so one outlying length makes all cells wide. Null lengths link nothing.
    """
    held = df.where(F.col(length).isNotNull())
    (most,) = _longest(held, [length], combine)
    if most <= 0:
        most = 1e-300
    fits = F.col("distance") <= COMBINE[combine][0](F.col("x"), F.col("y"))
    return pairs(held, row, axes, most, box, keep=length).where(fits).select("a", "b", "distance")


def line_of_sight_pairs(
    df: DataFrame, row: str, axes: Sequence[str], across: str | float, along: str | float, observer: Sequence[float] = (0.0, 0.0, 0.0), los: str | None = None, combine: str = "mean"
) -> DataFrame:
    """``a, b, across, along`` with a < b of the pairs close to each other across and along the line of sight.

    Across is the chord between the directions at the mean distance, along the difference of ``los``, or of the distances. The limits are numbers
    or columns. Rows are dealt by the power of two of their distance. For each two of these the mean distance has a least value, from which and
    from the greatest limit follows the width of the cells that directions are put into; rows meet by equality of the powers and of direction and
    parallel cells. Of two powers the one with fewer rows is copied to the cells around, of one power half of the cells around do. Neither side
    is broadcast: it is the copies that would be, which no estimate knows of. Rows at the observer or with a coordinate that isn't finite take no part.
    """
    shift = [F.col(a).cast("double") - o for a, o in zip(axes, observer, strict=True)]
    far = F.sqrt(reduce(Column.__add__, [s * s for s in shift]))
    limit = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")
    held = df.select(F.col(row).alias("id"), far.alias("d"), *[(s / far).alias(f"n{i}") for i, s in enumerate(shift)], (F.col(los).cast("double") if los else far).alias("l"), limit(across).alias("p"), limit(along).alias("q"))
    held = held.where("d > 0 and d < double('infinity') and abs(l) < double('infinity') and p >= 0 and q >= 0")
    perp, par = _longest(held, ["p", "q"], combine)
    perp, par = max(perp, 1e-9) * (1 + 1e-9), max(par, 1e-9) * (1 + 1e-9)
    # dealt by the row before the copies are made, so that a small file isn't one task
    held = cut(held.withColumn("level", F.floor(F.log2("d")).cast("int")).repartition("id"))
    # a double has some two thousand powers of two at most
    counts = sorted((r[0], r[1]) for r in held.groupBy("level").agg(F.count(F.lit(1))).collect())
    deal = [(lo, hi, lo if n <= m else hi) for i, (lo, n) in enumerate(counts) for hi, m in counts[i:] if los or 2.0**hi - 2.0 ** (lo + 1) <= par]
    meets = lambda rows: F.broadcast(df.sparkSession.createDataFrame(rows, "level int, lo int, hi int"))
    # the mean distance is half of 2^lo + 2^hi at least
    width = F.greatest(F.lit(2 * perp) / (F.pow(F.lit(2.0), F.col("lo")) + F.pow(F.lit(2.0), F.col("hi"))), F.lit(1e-9))
    cells = [F.floor(F.col(f"n{i}") / width).cast("long") for i in range(len(axes))] + [F.floor(F.col("l") / par).cast("long")]
    keys = [f"c{i}" for i in range(len(cells))]
    around = list(itertools.product((-1, 0, 1), repeat=len(cells)))
    steps = lambda some: F.array(*[F.array(*map(F.lit, s)) for s in some])
    near = held.join(meets([(c, lo, hi) for lo, hi, c in deal]), "level").withColumns(dict(zip(keys, cells, strict=True)))
    near = near.withColumn("step", F.explode(F.when(F.col("lo") == F.col("hi"), steps(s for s in around if s >= (0,) * len(cells))).otherwise(steps(around))))
    near = near.withColumns({k: F.col(k) + F.col("step")[i] for i, k in enumerate(keys)})
    near = near.withColumn("own", (F.col("lo") == F.col("hi")) & F.forall("step", lambda s: s == 0)).drop("step")
    there = held.join(meets([(lo if c == hi else hi, lo, hi) for lo, hi, c in deal]), "level").withColumns(dict(zip(keys, cells, strict=True)))
    x, y = near.alias("x"), there.hint("merge").alias("y")
    on = reduce(Column.__and__, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ["lo", "hi", *keys]]) & (F.col("x.id") != F.col("y.id"))
    chord = F.sqrt(reduce(Column.__add__, [F.pow(F.col(f"x.n{i}") - F.col(f"y.n{i}"), F.lit(2)) for i in range(len(axes))]))
    mix = COMBINE[combine][0]
    met = x.join(y, on & (~F.col("x.own") | (F.col("x.id") < F.col("y.id")))).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), (chord * (F.col("x.d") + F.col("y.d")) / 2).alias("across"), F.abs(F.col("x.l") - F.col("y.l")).alias("along"),
        (mix(F.col("x.p"), F.col("y.p")) if isinstance(across, str) else F.lit(float(across))).alias("p"), (mix(F.col("x.q"), F.col("y.q")) if isinstance(along, str) else F.lit(float(along))).alias("q"),
    )
    return met.where("across <= p and along <= q").select("a", "b", "across", "along")


def knn(df: DataFrame, row: str, axes: Sequence[str], k: int, radius: float) -> DataFrame:
    """``a, rank, b, distance``: the k nearest others of each row, ties to the smaller row.

    Rings of doubled radius are searched for the rows that have fewer than k neighbours so far, until all have k. The first is ``radius``, or less
    where the table is so dense that it would hold many more than k. Of rows at one place the k + 1 smallest are all that can be anyone's
    neighbours, so copies don't meet each other by the square. Rows with a coordinate that is null or not finite take no part.
    """
    df = df.where(_finite(axes)).select(row, *axes)
    todo, done, total = df, None, df.count()
    want = min(k, total - 1)
    if want < 1:
        return cross_pairs(df.limit(0), df.limit(0), row, row, axes, radius).select("a", F.lit(1).alias("rank"), "b", "distance")
    first = F.row_number().over(Window.partitionBy(*axes).orderBy(row))
    there = cut(df.withColumn("__nth", first).where(F.col("__nth") <= k + 1).drop("__nth"))
    order = Window.partitionBy("a").orderBy("distance", "b")
    # beyond the widest extent every row is within the radius
    extent = df.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    radius = _first_radius(there, axes, radius, k + 1, 1e-9 * max(extent))
    for _ in range(1 + max(0, math.ceil(math.log2(max(1.0, len(axes) * max(extent) / radius)))) + 1):
        near = cross_pairs(todo, there, row, row, axes, radius).where("a != b")
        ranked = cut(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want))
        full = ranked.where(F.col("rank") == want).select("a")
        part = ranked.join(full, "a", "left_semi").select("a", "rank", "b", "distance")
        done = part if done is None else done.union(part)
        todo = cut(todo.join(full, F.col(row) == F.col("a"), "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 2
    raise RuntimeError("rows are left without neighbours; are the row numbers unique?")


def _first_radius(df: DataFrame, axes: Sequence[str], radius: float, rows: int, least: float) -> float:
    """The radius, or less of it, at which a row shares its cell with some ``rows`` others at most in the mean."""
    while radius > least:
        cells, _ = _cells(axes, radius, None)
        counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
        met = counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if met <= 2 * rows:
            break
        radius *= max(0.1, (rows / met) ** (1 / len(axes)))
    return radius


def friends(df: DataFrame, row: str, axes: Sequence[str], linking: float, box: Sequence[float] | None = None, min_size: int = 1) -> DataFrame:
    """``row, group, size``: friends-of-friends groups, labelled by their smallest row."""
    links = pairs(df, row, axes, linking, box).select("a", "b")
    found = connected_components(links, "a", "b")
    labelled = df.select(row).join(found, F.col(row) == F.col("node"), "left").select(row, F.coalesce("component", F.col(row)).alias("group"))
    sizes = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return labelled.join(sizes, "group").select(row, "group", "size")

"""Fuzzy line dedup, with DataFrame operations only.

Lines are the parts of a text between line feeds; blank ones are never duplicates. The hashes of a line's shingles of SHINGLE
characters are dealt over GROUPS * BUCKETS buckets, of which each keeps its least; ROWS neighbouring buckets make a band, so there
are GROUPS * BUCKETS / ROWS bands. Lines that agree on a band are candidates; their exact Jaccard similarity over all shingles,
THRESHOLD or more, makes a link, and the connected components of the links keep one line each: the first by (doc_id, line number).

Every line of a band is first compared with the band's hub, the line that meets most others over all its bands. Then the pairs of a
band that no chain of links connects yet are compared, unless bits of the two lines' shingles prove them below the threshold. A band in
which more than BLOCK lines are left is dealt anew by AGAIN signatures of BUCKETS fresh hashes each, so that a line meets few
others of a crowd that has only a passage in common; whatever is larger still is compared block by block, every pair of blocks being a task's work of
its own. Equal lines are one line here, merged by partial aggregation, so a line that makes up a third of all rows costs a row a task.

Of pairs at a similarity of exactly 0.8 the bands miss (1 - 0.8^3)^8 = 0.32 %, and those that meet in crowded bands only another
(1 - 0.8^6)^20 = 0.23 %; the share falls fast above that. Nothing else is left out.

Edge cases: null text has no lines; a line shorter than a shingle is one shingle; rows with one id and one text act as one
document and are treated alike; a null doc_id sorts first. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut, release

SHINGLE, GROUPS, BUCKETS, ROWS, THRESHOLD = 8, 4, 6, 3, 0.8
#: Signatures by which a crowded band is dealt anew.
AGAIN = 20
#: Bits of a shingle's hash that are compared within a bucket.
BITS = 24

#: 64-bit words by which pairs are ruled out before they are compared (a power of 2), and lines of a band that one task compares with as many.
WORDS, BLOCK = 16, 1024
#: Most bits of the table by which rows without a partner are left out of a shuffle: 32 MB. Beyond it all rows are shuffled.
TABLE_BITS = 28
#: Most keys that are broadcast to a join; beyond it both sides are shuffled.
BROADCAST = 500_000

_LONE = "-9223372036854775808"
_EMPTY = 1 << 62


def maybe_in(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column may be in ``wanted`` (one column, stored): none that is gets lost, few that aren't stay."""
    size = max(15, math.ceil(math.log2(8 * wanted.count() + 1)))
    if size > TABLE_BITS:
        return rows

    def spot(c: Column) -> Column:
        return F.xxhash64(c, F.lit("spot")).bitwiseAND(F.lit((1 << size) - 1))

    mine = spot(F.col(wanted.columns[0]))
    bits = wanted.groupBy(F.bitmap_bucket_number(mine).alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mine)).alias("__bits"))
    at = F.bitmap_bit_position(spot(F.col(name)))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return rows.withColumn("__page", F.bitmap_bucket_number(spot(F.col(name)))).join(F.broadcast(bits), "__page").where(hit).drop("__page", "__bits")


def _small(rows: DataFrame) -> DataFrame:
    """A stored table, marked for a broadcast if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _doc_keys() -> list[Column]:
    """128 bits that tell documents apart by id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit("document")).alias("k2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n, line``: every line that isn't blank."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .select("doc_id", *_doc_keys(), F.posexplode(F.split("text", "\n")).alias("n", "line"))
        .where(F.trim("line") != "")
    )


def _ids() -> list[Column]:
    """A line's 64-bit id, and 64 bits more by which equal ids of different lines are noticed."""
    return [F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit("line")).alias("check")]


def _starts(encoded: Column, size: int) -> Column:
    """Where the shingles of a line begin, in bytes from 1, if a character takes ``size`` of them; a short line has one."""
    return F.sequence(F.lit(1), F.greatest(F.length(encoded) - size * SHINGLE, F.lit(0)) + 1, F.lit(size))


def signatures(lines: DataFrame, groups: int, salt: int = 0) -> DataFrame:
    """``id, g, m0, m1, ...``: the least hash of each bucket of each group, for every distinct line; null where there is none."""
    hashed = (
        lines.select(F.xxhash64("line").alias("id"), F.encode("line", "UTF-32").alias("b"))
        .select("id", "b", F.explode(_starts(F.col("b"), 4)).alias("i"))
        .select("id", F.xxhash64(F.substring("b", F.col("i"), F.lit(4 * SHINGLE)), *[F.lit(salt)] * (salt > 0)).alias("h"))
        .select(
            "id",
            F.pmod(F.shiftrightunsigned("h", 52).cast("int"), F.lit(groups)).alias("g"),
            F.pmod(F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(0xFFF)).cast("int"), F.lit(BUCKETS)).alias("bucket"),
            F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)).alias("v"),
        )
    )
    # a row a group keeps the minima that a shingle may change few
    least = hashed.groupBy("id", "g").agg(*[F.min(F.when(F.col("bucket") == j, F.col("v")).otherwise(F.lit(_EMPTY))).alias(f"m{j}") for j in range(BUCKETS)])
    return least.select("id", "g", *[F.nullif(F.col(f"m{j}"), F.lit(_EMPTY)).alias(f"m{j}") for j in range(BUCKETS)])


def bands(signed: DataFrame, rows: int) -> DataFrame:
    """``id, k0, k1, ...``: a key for each ``rows`` buckets of a group; an empty bucket borrows from the group's next."""
    full = [F.coalesce(*[F.col(f"m{(j + k) % BUCKETS}") for k in range(BUCKETS)]) for j in range(BUCKETS)]
    return signed.select("id", *[F.xxhash64("g", F.lit(b), *full[b : b + rows]).alias(f"k{b // rows}") for b in range(0, BUCKETS, rows)])


def _shingles(line: Column, wide: Column) -> Column:
    """The shingle hashes of a line, repeats included; ``wide`` says whether its encoding must hold characters beyond 16 bits."""

    def each(encoding: str, size: int) -> Column:
        return F.transform(
            F.array(F.encode(line, encoding)),
            # steps of a character, as an expression for each shingle isn't compiled
            lambda b: F.transform(_starts(b, size), lambda i: F.xxhash64(F.substring(b, i, F.lit(size * SHINGLE)))),
        )[0]

    return F.when(wide, each("UTF-32", 4)).otherwise(each("UTF-16BE", 2))


def _wide(line: Column) -> Column:
    return F.length(F.encode(line, "UTF-16BE")) != 2 * F.length(line)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ids whose lines reach the threshold."""
    one, two = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    x, y = F.col("x"), F.col("y")
    wide = _wide(x) | _wide(y)
    # generated, so that a pair's sets and their union are made once and compared in compiled code
    made = pairs.join(one, "a").join(two, "b").select("a", "b", F.explode(F.array(F.struct(_shingles(x, wide).alias("s"), _shingles(y, wide).alias("t")))).alias("p"))
    sized = made.select("a", "b", "p", F.explode(F.array(F.size(F.array_union("p.s", "p.t")))).alias("all"))
    # sizes with repeats allow no fewer shared shingles than there are, so most pairs below the threshold need no intersection
    may = F.size("p.s") + F.size("p.t") >= F.lit(1 + THRESHOLD) * F.col("all") - F.lit(1e-6)
    return sized.where(may & (F.size(F.array_intersect("p.s", "p.t")) >= F.lit(THRESHOLD) * F.col("all") - F.lit(1e-9))).select("a", "b")


def marks(texts: DataFrame) -> DataFrame:
    """``id, size, w0, w1, ...``: how many distinct shingles a line has, and WORDS * 64 bits, each being the parity of the shingles at it."""
    line = F.col("line")
    spread = texts.select("id", F.explode(F.array(F.array_distinct(_shingles(line, F.lit(True))))).alias("s")).select("id", F.size("s").alias("size"), F.explode("s").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(h & 63 as int))")
    none = F.lit(0).cast("long")
    words = [F.coalesce(F.bit_xor(F.when(word == j, bit).otherwise(none)), none).alias(f"w{j}") for j in range(WORDS)]
    return spread.groupBy("id").agg(F.coalesce(F.min("size"), F.lit(0)).alias("size"), *words)


def _may_be_like(a: str, b: str) -> Column:
    """False only of pairs below the threshold.

    Shared shingles cancel out in the exclusive or of two lines' parities, so every bit left is a shingle that one of them lacks;
    the similarity is (m + n - d) / (m + n + d) for d such shingles.
    """
    d = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.w{j}").bitwiseXOR(F.col(f"{b}.w{j}"))) for j in range(WORDS)])
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    # similar()'s own comparison, with a margin for rounding
    return (1 + THRESHOLD) * d <= (1 - THRESHOLD) * both + F.lit(1e-6)


def _open(rows: DataFrame) -> DataFrame:
    """``key, id, c, n``: the lines of the bands that hold lines of several components, and the band's size."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    return rows.join(sizes.where("least < most").select("key", "n"), "key").select("key", "id", "c", "n")


def _rest(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: pairs of a band's lines that no chain of links connects and that may reach the threshold."""
    placed = cut(rows.join(nodes.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    left = cut(_open(placed))
    crowd = cut(left.where(F.col("n") > BLOCK).select("id", "c").distinct())
    if not crowd.isEmpty():
        anew = bands(signatures(texts.join(crowd, "id", "left_semi"), AGAIN, 1), BUCKETS)
        dealt = crowd.join(anew, "id").select(F.col("k0").alias("key"), "id", "c")
        left = cut(left.where(F.col("n") <= BLOCK).union(_open(cut(dealt))))
    marked = marks(texts.join(left.select("id").distinct(), "id", "left_semi"))
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    # a pair is compared in the first of the bands that it shares
    own = left.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    blocks = cut(left.join(marked, "id").join(own, "id").withColumn("many", many).withColumn("at", F.pmod(F.xxhash64("id", F.lit("block")), many).cast("int")))
    once = F.array_intersect("x.keys", "y.keys")[0] == F.col("x.key")
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    # a band of one block meets itself: both sides are dealt out by one exchange
    single = blocks.where("many = 1")
    alike = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.id") < F.col("y.id"))
    pairs = single.alias("x").hint("merge").join(single.alias("y"), alike & _may_be_like("x", "y") & once).select(*ends)
    blocks = blocks.where("many > 1")
    if blocks.isEmpty():
        return pairs
    # every pair of a band's blocks is a task's work of its own
    one = blocks.withColumn("other", F.explode(F.sequence(F.col("at"), F.col("many") - 1))).alias("x")
    two = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at")))).alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.other")) & (F.col("x.other") == F.col("y.at"))
    new = (F.col("x.c") != F.col("y.c")) & ((F.col("x.at") < F.col("y.at")) | (F.col("x.id") < F.col("y.id")))
    return pairs.union(one.hint("merge").join(two, met & new & _may_be_like("x", "y") & once).select(*ends))


def line_components(lines: DataFrame) -> DataFrame:
    """``node, component``: of the ids of the lines that are linked to another line."""
    keyed = cut(bands(signatures(lines, GROUPS), ROWS)).select("id", F.explode(F.array(*[f"k{b}" for b in range(BUCKETS // ROWS)])).alias("key"))
    release(lines.sparkSession)  # signatures are most of what is shuffled
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1"))
    # a band of two is a pair already; only the lines of larger bands are looked up
    rows = cut(keyed.join(_small(shared.where("n > 2").select("key", "n")), "key").select("key", "id", "n"))
    del keyed
    release(lines.sparkSession)
    # a line with many copies meets most of them in each of its bands, a copy only some
    hubs = rows.join(rows.groupBy("id").agg(F.sum("n").alias("met")), "id").groupBy("key").agg(F.max_by("id", F.struct("met", "id")).alias("hub"))
    led = rows.join(hubs, "key").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = cut(led.union(shared.where("n = 2").select("a", "b")).distinct())
    del shared, hubs, led
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    named = maybe_in(lines.select(F.xxhash64("line").alias("id"), "line"), "id", ids)
    texts = cut(named.groupBy("id", "line").agg(F.lit(1)).join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "line"))
    release(lines.sparkSession)
    links = cut(similar(pairs, texts))
    del pairs, ids, named
    release(lines.sparkSession)
    nodes = cut(connected_components(links, "a", "b"))
    release(lines.sparkSession)
    more = cut(similar(_rest(rows, nodes, texts), texts))
    release(lines.sparkSession)
    if more.isEmpty():
        return nodes
    # the later links join components of the earlier ones
    where = nodes.withColumnRenamed("component", "c")
    ends = more.join(where.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a", "left").join(where.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b").withColumnRenamed("node", "c")
    every = where.union(joined.select(F.col("c").alias("node"), "c")).distinct()
    return cut(every.join(joined, "c", "left").select("node", F.coalesce("component", "c").alias("component")))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n, class_doc, class_line, kept`` for every line that isn't blank.

    (class_doc, class_line) is where the line's component occurs first.
    """
    lines = lines_of(docs)
    nodes = line_components(lines)
    shift = F.lit(1 << 31).cast("decimal(12,0)")
    place = (F.coalesce(F.col("doc_id"), F.lit(int(_LONE))).cast("decimal(20,0)") * shift + F.col("n")).cast("decimal(38,0)")
    placed = lines.select("doc_id", "k1", "k2", "n", *_ids(), place.alias("at"))
    # least check of an id: a different line with the same id is left alone
    ids = cut(placed.groupBy("id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"), F.min("check").alias("mine")).join(nodes.withColumnRenamed("node", "id"), "id", "left").where("c > 1 or component is not null"))
    firsts = ids.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    first = F.coalesce("least", "first")
    doc = F.floor(first / shift)
    known = ids.join(firsts, "component", "left").select("id", "mine", doc.cast("long").alias("first_doc"), (first - doc * shift).cast("int").alias("first_n"))
    found = placed.drop("at").join(known, "id", "left")
    same = F.coalesce(F.col("check") == F.col("mine"), F.lit(False))
    own = F.coalesce("doc_id", F.lit(int(_LONE)))
    class_doc, class_n = F.when(same, F.col("first_doc")).otherwise(own), F.when(same, F.col("first_n")).otherwise(F.col("n"))
    return found.select(
        "doc_id",
        "k1",
        "k2",
        F.col("n").alias("line_no"),
        F.nullif(class_doc, F.lit(int(_LONE))).alias("class_doc"),
        class_n.alias("class_line"),
        ((class_doc == own) & (class_n == F.col("n"))).alias("kept"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows with the lines taken out that are kept elsewhere; ``n_chars``, if there, is the new length."""
    gone = classes(docs).where(~F.col("kept")).groupBy("k1", "k2").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__gone")
    k1, k2 = F.xxhash64(F.col("doc_id").cast("long"), "text"), F.xxhash64("text", F.col("doc_id").cast("long"), F.lit("document"))
    joined = docs.join(gone, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left")
    parts = F.split("text", "\n")
    # a set difference of the places, so that the work follows the number of lines
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    left = F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n"))[0]
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length(left)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])

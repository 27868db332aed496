"""Line deduplication by an exact set-similarity join; DataFrame functions only.

A line is the set of its lower-cased words. Two lines match when the Jaccard
similarity of their sets is at least the threshold. Words are put in order of
rarity; matching sets then share a word among the first n - ceil(t n) + 1 of
either (prefix filter), have sizes within a factor t (length filter), can still
reach the overlap behind the shared word (positional filter), and differ in
few enough words (a parity of the words bounds that from below: 64 bits for
lines of up to 64 words, 128 for longer ones, of which 64 say nothing). Words
that occur once in all texts are shared by no two lines and leave the prefixes.
What passes is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridfold.llm.common import bitmap, in_bitmap
from gridfold.session import stage

#: Counters of the rarity sketch: a fixed 4 MiB, one class (a byte) each. Words
#: that share a counter with more frequent ones are taken for as frequent, so
#: too few counters put common words into the prefixes.
BUCKETS = 1 << 22
#: Counters that travel to the driver in one row (a place is two characters of 8 bits).
RUN = 1 << 16
#: Parts of the prefix words that are joined one after the other, so that the
#: rows of one part at a time lie on disk.
PARTS = 2
#: Keys of :func:`_ordered` below this are of words that occur once: their class is 1.
ONCE = 2 << 56
#: Keys below this are of words that occur less than 1,024 times: their class is at most 40.
#: All pairs of lines that share such a word are looked at, 512 a line on average at most.
HOT = 41 << 56
#: Lines of at most this many words have a parity of 64 bits.
SHORT = 64


def _pieces(text: Column, spaces: str = "\t\x0b\f\r") -> Column:
    """A lower-cased text cut at each blank and each of ``spaces``: its words, and
    empty ones. One character is split by without a regular expression, which takes longer."""
    return F.split(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), spaces, F.lower(text)), " ")


def words(line: Column) -> Column:
    """The distinct words of a line, without the empty one."""
    return F.array_distinct(F.array_remove(_pieces(line), ""))


def _bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 65 - BUCKETS.bit_length()).cast("int")


def rarity_classes(texts: DataFrame) -> DataFrame:
    """One row, ``classes``: for each bucket of word hashes, a byte 1..127 that
    rises with the number of occurrences in all texts (four classes to a factor
    of two). A frame, so that plans refer to it instead of spelling it out."""
    each = texts.select(F.explode(_pieces(F.col("text"), "\n\t\x0b\f\r")).alias("w")).where("w <> ''")
    counts = each.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    step = F.least(F.lit(127), 1 + F.floor(4 * F.log2("count"))).cast("int")
    runs = counts.groupBy(F.floor(F.col("b") / RUN).alias("run")).agg(F.collect_list(128 * F.col("b") % (128 * RUN) + step).alias("seen"))
    chars = lambda bits, most: F.array_join(F.transform("seen", lambda x: F.char(F.shiftright(x, bits).bitwiseAND(F.lit(most)))), "")
    out = np.ones(BUCKETS, dtype=np.int8)
    for run, *row in runs.select("run", chars(15, 255), chars(7, 255), chars(0, 127)).collect():  # at most BUCKETS / RUN rows
        high, low, steps = (np.frombuffer(x.encode("latin-1"), dtype=np.uint8).astype(np.int64) for x in row)
        out[run * RUN + 256 * high + low] = steps
    one = pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), pa.array(out))
    return texts.sparkSession.createDataFrame(pa.table({"classes": one}))


def _ordered(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """``lines`` with ``w``, hashes of the distinct words in ``words``, rarest first
    (class, then hash, in one long), and their number ``n``, instead of ``words``."""

    def key(h: Column, rank: Column) -> Column:
        c = F.get(rank, F.shiftrightunsigned(h, 65 - BUCKETS.bit_length())).cast("long")
        return F.shiftleft(c, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    keep = [c for c in lines.columns if c != "words"]
    hashes = F.transform(_pieces(F.col("words")), lambda w: F.xxhash64(w))
    rows = lines.select(*keep, F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))).alias("h"))
    # the classes are named once, as the element of an array, and the hashes more than once
    # beside them: so Spark puts the classes into no row, and works the hashes out by themselves
    rows = rows.select(*keep, "h", F.size("h").alias("n"), classes.scalar().alias("rank"))
    ranked = F.get(F.transform(F.array("rank"), lambda rank: F.transform("h", lambda h: key(h, rank))), F.lit(0))
    return rows.select(*keep, F.sort_array(ranked).alias("w"), "n")


def _overlap(n: Column, m: Column, t: float) -> Column:
    """Common words that sets of sizes n and m need (guarded against rounding)."""
    return F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def _may_match(x: Callable[[str], Column], y: Callable[[str], Column], t: float) -> Column:
    """Length, positional and parity filters on the fields of two rows of prefix words, x of the earlier set."""
    n, m = (F.shiftright(r("at"), 32) for r in (x, y))
    pos, other = (F.shiftright(r("at"), 1).bitwiseAND(F.lit((1 << 31) - 1)) for r in (x, y))
    need = _overlap(n, m, t)
    behind = 1 + F.least(n - pos, m - other)
    odd, even = (x(p).bitwiseXOR(y(p)) for p in ("odd", "even"))
    halves, whole = F.bit_count(odd) + F.bit_count(even), F.bit_count(odd.bitwiseXOR(even))
    differ = F.when(F.least(n, m) > SHORT, halves).otherwise(whole)
    return (x("sid") < y("sid")) & (F.least(n, m) >= F.greatest(n, m) * t - 1e-9) & (behind >= need) & (differ <= n + m - 2 * need)


def _prefix_length(n: Column, t: float) -> Column:
    return (n - F.ceil(n * t - 1e-9) + 1).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``doc``, a key of both, by which rows are told apart."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select("doc_id", text).withColumn("doc", F.xxhash64("doc_id", "text"))


def line_sets(docs: DataFrame, threshold: float, classes: DataFrame) -> DataFrame:
    """doc_id, doc, line, set, n, the parities ``odd`` and ``even`` (0 in a short line)
    and the words of the prefix, ``prefix`` and behind them ``hot``, for each line with a word."""
    lines = docs.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("line", "words")).where(r"words RLIKE '\\S'")
    lines = _ordered(lines, classes)
    # the bit of a word is read from a list, which takes fewer steps than to shift it
    bits = [F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]
    none = [F.lit(0).cast("long")] * 64
    parity = lambda of: F.aggregate("w", none[0], lambda a, w: a.bitwiseXOR(F.get(F.array(*of), w.bitwiseAND(F.lit(len(of) - 1)))))
    short = F.col("n") <= SHORT
    odd, even = F.when(short, parity(bits)).otherwise(parity(none + bits)), F.when(short, none[0]).otherwise(parity(bits + none))
    first = F.slice("w", 1, _prefix_length(F.col("n"), threshold))
    short_word = lambda w: w.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    prefix, hot = F.filter(first, lambda w: (w >= ONCE) & (w < HOT)), F.filter(first, lambda w: w >= HOT)
    return lines.select("doc_id", "doc", "line", F.xxhash64("w").alias("set"), "n", odd.alias("odd"), even.alias("even"),
                        F.transform(prefix, short_word).alias("prefix"), F.transform(hot, short_word).alias("hot"))


def _split(sets: DataFrame, sids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that a bitmap of ``sids`` (a written table) shows, with few others, and the rest."""
    some = in_bitmap(bitmap(sids.select(F.xxhash64("sid").alias("key"))), F.xxhash64("sid"))
    return sets.where(some), sets.where(~some)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """(x, y): the pairs of set numbers whose lines have the similarity. Only the
    lines of these pairs, and those a bitmap can't tell from them, are moved."""
    spark = docs.sparkSession
    wanted = stage(spark, pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "line-wanted")
    places = stage(spark, _split(sets, wanted)[0].join(wanted, "sid").select("sid", "doc", "line"), "line-places")
    key = F.xxhash64("doc", "line")
    bits = bitmap(places.select(key.alias("key")))
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "words")).where(in_bitmap(bits, key))
    text = stage(spark, lines.join(places, ["doc", "line"]).select("sid", F.col("words").alias("text")), "line-texts")
    # texts travel as they are: as arrays of words they would be several times as large.
    # The lambda binds the words, which a plain condition would split anew at each mention.
    both = pairs.join(text.toDF("x", "xt"), "x").join(text.toDF("y", "yt"), "y")
    sides = F.array(F.struct(words(F.col("xt")).alias("x"), words(F.col("yt")).alias("y")))
    alike = F.exists(sides, lambda s: F.size(F.array_intersect(s.x, s.y)) >= _overlap(F.size(s.x), F.size(s.y), t))
    return both.where(alike).select("x", "y")


def later_matches(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc, line) of each line that matches an earlier one, by (doc_id, doc, line),
    rows without a doc_id last. ``docs`` as from :func:`keyed`.

    Lines with one set are one class, numbered in the order of their first line.
    Sets that share a word of their prefixes are paired, but for hot words. A
    set is settled once it matches any earlier set, so of those that share a hot
    word only three are paired with it at first: the earliest and the two just
    before it. It is held against the earliest of all it is paired with. Only
    sets that don't match that are held against the others, and joined by hot words
    with all earlier ones. That way a group of many variants of a line does
    not yield all of its pairs.
    """
    spark = docs.sparkSession
    lines = stage(spark, line_sets(docs, threshold, rarity_classes(docs)), "line-sets")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "line")
    rest = ("n", "odd", "even", "prefix", "hot")
    sets = lines.groupBy("set").agg(F.min(place).alias("first"), *(F.any_value(c).alias(c) for c in rest))
    sets = sets.sort("first").select(F.monotonically_increasing_id().alias("sid"), "set", "first.doc", "first.line", *rest)
    sets = stage(spark, sets, "line-classes")

    def by_word(classes: DataFrame, words: str, open: Column, part: int) -> DataFrame:
        """A row for each of ``words`` in this part; n, pos and ``open`` travel as one long, ``at``."""
        # words that occur once come first and hot ones last, so what is left of a prefix is its end
        behind = F.size("hot") + (F.size("prefix") if words == "prefix" else 0)
        skipped = _prefix_length(F.col("n"), threshold) - behind + 1
        size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(open.cast("long"))
        each = classes.select("sid", "odd", "even", size.alias("size"), skipped.alias("skipped"), F.posexplode(words).alias("pos", "word"))
        each = each.where(F.pmod("word", F.lit(PARTS)) == part)
        return each.select("word", "sid", (F.col("size") + 2 * (F.col("skipped") + F.col("pos"))).alias("at"), "odd", "even")

    def staged(parts: list[DataFrame], label: str) -> DataFrame:
        return reduce(DataFrame.union, [stage(spark, p.distinct(), label) for p in parts])

    def joined(rows: DataFrame) -> DataFrame:
        both = rows.alias("x").join(rows.alias("y"), F.col("x.word") == F.col("y.word"))
        return both.where(_may_match(lambda f: F.col(f"x.{f}"), lambda f: F.col(f"y.{f}"), threshold))

    numbers = (F.col("x.sid").alias("x"), F.col("y.sid").alias("y"))

    def shared(part: int) -> DataFrame:
        return joined(by_word(sets, "prefix", F.lit(0), part)).select(*numbers)

    def near(part: int) -> DataFrame:
        rows = by_word(sets, "hot", F.lit(0), part).select("word", F.struct("sid", "at", "odd", "even").alias("y"))
        turn = W.partitionBy("word").orderBy("y.sid")
        each = F.array(F.first("y").over(turn), F.lag("y", 1).over(turn), F.lag("y", 2).over(turn))
        rows = rows.select("y", each.alias("x")).where("x[1] IS NOT NULL")
        # filtered before they are rows: most of them go
        may = F.filter("x", lambda x: _may_match(lambda f: x[f], lambda f: F.col(f"y.{f}"), threshold))
        return rows.select("y", F.explode(may).alias("x")).select(*numbers)

    found = staged([shared(k) for k in range(PARTS)], "line-shared").union(staged([near(k) for k in range(PARTS)], "line-near"))
    # one pair settles most sets, so the texts of their other pairs are not compared
    first = stage(spark, found.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "line-pairs")
    settled = stage(spark, _verified(first, sets, docs, threshold).select(F.col("y").alias("sid")).distinct(), "line-settled")

    some, others = _split(sets, settled)
    marked = some.join(settled.withColumn("done", F.lit(1)), "sid", "left").unionByName(others.withColumn("done", F.lit(None).cast("int")))

    def later(part: int) -> DataFrame:
        both = joined(by_word(marked.where(F.size("hot") > 0), "hot", F.col("done").isNull(), part))
        # y's open bit is part of what both sides need, so they read one exchange
        return both.where((F.col("x.sid") < F.col("y.sid")) == (F.col("y.at").bitwiseAND(F.lit(1)) == 1)).select(*numbers)

    rest = staged([later(k) for k in range(PARTS)], "line-later").union(found.join(settled.toDF("y"), "y", "left_anti").select("x", "y"))
    rest = stage(spark, rest.distinct().join(first, ["x", "y"], "left_anti"), "line-rest")
    settled = stage(spark, settled.union(_verified(rest, sets, docs, threshold).select("y")).distinct(), "line-settled")

    some, others = _split(sets, settled)
    kept = some.join(settled, "sid", "left_anti").unionByName(others).select("set", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
    match = lines.select("doc", "line", "set").join(kept, "set", "left")
    return match.where("first_doc IS NULL OR first_doc <> doc OR first_line <> line").select("doc", "line")


def remove_lines(docs: DataFrame, matches: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` of ``docs`` (with ``doc``), n_lines, n_removed, and ``text``, which
    is worked out from these columns and moved as part of them, without its
    matches. Documents that a bitmap shows to have none are not moved."""
    gone = stage(docs.sparkSession, matches.groupBy("doc").agg(F.collect_set("line").alias("gone")), "line-gone")
    some = in_bitmap(bitmap(gone.select(F.col("doc").alias("key"))), F.col("doc"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    cut = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    rows = docs.select("doc", *columns)
    hit = rows.where(some).join(gone, "doc", "left").withColumn("lines", F.split(text, "\n"))
    counts = {"n_lines": F.size("lines").cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    hit = hit.withColumns(counts | {"text": cut}).drop("doc", "lines", "gone")
    counts = {"n_lines": F.size(F.split(text, "\n")).cast("long"), "n_removed": F.lit(0).cast("long")}
    return hit.unionByName(rows.where(~some).withColumns(counts | {"text": text}).drop("doc"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text, n_lines, n_removed per row: the text without the lines that
    match an earlier line of any document.

    Lines end at line feeds; lines without a word never match and stay. Whether
    the earlier line is itself removed does not matter. A null or empty text
    has one line without a word. Rows that repeat doc_id and text are one
    document: both keep the same lines. Rows without a doc_id come after all
    others. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a Jaccard similarity in (0, 1]")
    rows = keyed(docs)
    out = remove_lines(rows, later_matches(rows, threshold), ["doc_id", "text"], F.col("text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def dedup_line_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with all its columns, its texts as :func:`dedup_lines` leaves them;
    ``n_chars``, where there is one, follows a changed text."""
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("doc", F.xxhash64("row.doc_id", text))
    out = remove_lines(rows, later_matches(keyed(docs), threshold), ["row"], text)
    changed = F.col("n_removed") > 0
    row = F.col("row").withField("text", F.when(changed, F.col("text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")

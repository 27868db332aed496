"""SimHash fingerprints of whole documents, and all neighbours within a radius.

DataFrame functions only. A term (a word, or two words in a row) votes on each of
the 64 bits, for it where its XXH64 has the bit and against it elsewhere, with a
weight that grows with the term's length; each occurrence counts. Neighbours
come from permuted block tables: six blocks of bits, one table for every choice
of three; fingerprints within three bits agree on the blocks of some table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridfold.session import stage

#: Bits summed in one long: every 21st, so each has 21 bits of room.
LANES, ROOM = 3, 21
#: Words added up before their sums are split into bits. Each begins two terms:
#: WORDS x 2 x MAX_WEIGHT is under 2**21.
WORDS, MAX_WEIGHT = 1 << 16, 15
BLOCKS = (11, 11, 11, 11, 10, 10)


def simhash(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (a signed long, 0 where the text has no word), one row
    for each distinct ``keys``.

    Three bits are counted in one long, 21 bits apart, and sums of at most 65,536
    words are taken apart before they are added up, so no count overflows
    however long a text is. Sums are partial before the shuffle, so a text is
    never moved."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    each = texts.select(*keys, words.alias("w")).select(*keys, "w", F.posexplode("w").alias("pos", "word"))
    pair = F.concat_ws(" ", "word", F.get("w", F.col("pos") + 1))
    each = each.select(*keys, (F.col("pos") / WORDS).cast("int").alias("chunk"), F.explode(F.array("word", pair)).alias("term"))
    each = each.select(*keys, "chunk", F.xxhash64("term").alias("h"), F.least(F.length(F.trim("term")), F.lit(MAX_WEIGHT)).cast("long").alias("weight"))
    mask = sum(1 << ROOM * k for k in range(LANES))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(mask)) * F.col("weight")).alias(f"s{k}") for k in range(ROOM)]
    top = F.sum(F.shiftrightunsigned("h", 63) * F.col("weight")).alias("s63")
    by_chunk = each.groupBy(*keys, "chunk").agg(*sums, top, F.sum("weight").alias("total"))

    def votes(bit: int) -> Column:
        if bit == LANES * ROOM:
            return F.col("s63")
        return F.shiftrightunsigned(f"s{bit % ROOM}", bit // ROOM * ROOM).bitwiseAND(F.lit((1 << ROOM) - 1))

    whole = by_chunk.groupBy(*keys).agg(F.sum("total").alias("total"), *(F.sum(votes(b)).alias(f"v{b}") for b in range(64)))
    bits = [F.when(F.col(f"v{b}") * 2 > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return whole.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, near): both ways, all pairs of distinct fingerprints at most
    ``radius`` bits apart. ``fps`` holds each fingerprint once."""
    if not 0 <= radius <= 3:
        raise ValueError("three of six blocks stay equal within 3 bits only")
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    masks = [sum(((1 << BLOCKS[k]) - 1) << starts[k] for k in pick) for pick in combinations(range(len(BLOCKS)), 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed))))
    rows = fps.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    other = rows.withColumnRenamed("fp", "near")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("near")))
    return rows.join(other, ["t", "key"]).where((F.col("fp") != F.col("near")) & (far <= radius)).select("fp", "near").distinct()


def _sortable(x: Column) -> Column:
    """16 hex digits that sort as the long does."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def keyed(docs: DataFrame) -> DataFrame:
    """text (null: empty), and ``doc``, a string that tells documents apart and
    puts them in order: ids ascending, none last, then the hash of the text."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    doc = F.concat(F.when(i.isNull(), "1").otherwise("0"), _sortable(F.coalesce(i, F.lit(0).cast("long"))), _sortable(F.xxhash64(text)))
    return docs.select(doc.alias("doc"), text.alias("text"))


def _id_of(doc: str) -> Column:
    """The doc_id in a key."""
    i = F.conv(F.substring(doc, 2, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.substring(doc, 1, 1) == "0", i.cast("long"))


def next_documents(docs: DataFrame) -> DataFrame:
    """doc, next_doc, copies and the code points ``take`` to be replaced, for each
    distinct ``doc`` of :func:`keyed` rows in ascending order; the last one is
    followed by the first.

    They are sorted over the cluster and numbered by (partition, row); the next
    is the next row's, or the first of the next partition that has rows."""
    each = docs.groupBy("doc").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    rows = each.sort("doc").withColumn("at", F.monotonically_increasing_id())
    rows = stage(docs.sparkSession, rows, "fingerprint-order").withColumn("part", F.shiftrightunsigned("at", 33))
    firsts = rows.groupBy("part").agg(F.min("doc").alias("first"), F.max("at").alias("end"))
    turn = W.orderBy("part")  # one row for each partition of the sort
    ends = firsts.select("end", F.coalesce(F.lead("first").over(turn), F.first("first").over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    step = rows.select((F.col("at") - 1).alias("at"), F.col("doc").alias("following"))
    return (
        rows.join(step, "at", "left").join(ends, F.col("at") == F.col("end"), "left")
        .select("doc", F.coalesce("following", "after").alias("next_doc"), "copies", F.floor(F.col("n") / 4).cast("int").alias("take"))
    )


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_near: one row per row of ``docs``.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document's. ``n_near`` counts the other
    rows whose fingerprint is within ``radius`` bits; rows with equal
    fingerprints are one class, counted and not paired.

    A null text counts as empty; a text without words has fingerprint 0. Rows
    that share a doc_id follow one another in the order of their texts' XXH64;
    rows without a doc_id come last, in that order too. Rows that repeat both
    doc_id and text are one document, so that its next is another one, and
    each of them is returned. One document alone is followed by itself. An empty
    table gives an empty result; other columns are ignored.
    """
    whole = keyed(docs)
    order = stage(docs.sparkSession, next_documents(whole), "fingerprint-next")
    repeated = order.where("copies > 1").select("doc")
    if not repeated.isEmpty():  # else no text has to be held against the repeated ones
        one = whole.join(repeated, "doc").dropDuplicates(["doc"])
        whole = whole.join(repeated, "doc", "left_anti").unionByName(one)
    # the text moves once: both joins read the same exchange
    placed = whole.repartition("doc")
    heads = placed.join(order.select(F.col("next_doc").alias("doc"), F.col("doc").alias("before"), "take", "copies"), "doc").select(
        F.col("before").alias("doc"), F.col("doc").alias("next_doc"), "take", "copies", F.expr("substring(text, 1, take)").alias("head"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - take)"), F.col("head"))
    both = placed.join(heads, "doc").select("doc", "next_doc", "copies", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    facts = both.select("doc", "next_doc", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    return _finish(facts, radius)


def _finish(facts: DataFrame, radius: int) -> DataFrame:
    spark = facts.sparkSession
    fps = stage(spark, simhash(facts, "doc", "next_doc", "copies", "n_chars", "edited_sha256", "which"), "fingerprints")
    own = fps.where("which = 0").select("doc", "next_doc", "copies", "n_chars", "edited_sha256", "fp")
    edited = fps.where("which = 1").select("doc", F.col("fp").alias("edited_fp"))
    following = own.select(F.col("doc").alias("next_doc"), F.col("fp").alias("next_fp"))
    classes = stage(spark, own.groupBy("fp").agg(F.sum("copies").alias("n")), "fingerprint-classes")
    sizes = classes.withColumnRenamed("fp", "near").withColumnRenamed("n", "near_n")
    around = near_links(classes.select("fp"), radius).join(sizes, "near").groupBy("fp").agg(F.sum("near_n").alias("around"))
    counted = classes.join(around, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_near"))

    def text(c: str) -> Column:
        return F.lower(F.lpad(F.hex(c), 16, "0"))

    return (
        own.join(edited, "doc").join(following, "next_doc").join(counted, "fp")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(_id_of("doc").alias("doc_id"), "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
                likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
    )

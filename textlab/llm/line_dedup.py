"""Line dedup by winnowing: later copies of repeated runs of lines are deleted.

Lines differ much in length, so windows are measured in words. The gram of a line
is the run of lines that start within ``GRAM`` words from it; it exists if the text
goes on for so many words. Of all grams that start within ``REACH`` words the one
with the least hash is selected: a fingerprint. A run of ``GRAM + REACH - 1`` words
(50) or more that two texts share holds a whole window, so both select the same
gram in it, while only part of the grams is joined.

Each fingerprint is matched with all its earlier occurrences (by doc_id, then place) and
the match is extended line by line to both sides, as far as the neighbouring
fingerprints reach; beyond those, their own matches go on. A line counts as matched if
any earlier occurrence goes on alike up to it. The earliest occurrence settles most
lines; where an occurrence goes on otherwise than that one, every further step is
looked up among the occurrences that took the same steps: a step is known by
(fingerprint, side, number of steps, hash of the lines so far) and the earliest to
take it is a partial aggregate, so occurrences are never compared pair by pair and an
earlier fragment of a passage hides nothing. Matched lines that follow
one another make a run; runs of ``LEAST`` words or more are deleted, the first
occurrence stays. A common short line alone is no run.

The earliest occurrence of a fingerprint is a partial aggregate too, so a passage that a
third of all texts share is combined map-side and its copies join one row. Only
DataFrame functions run.

Defined results: a null text stays null and an empty one empty; a text without a
deleted line is returned unchanged; lines without a word are kept and not compared;
texts whose every line goes become empty (or their blank lines); rows that repeat the
same id and text are one document and get the same result; documents without an id
come after all others; an empty table gives an empty result. ``line_dedup`` keeps all
columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, saved

GRAM, REACH = 32, 19  # words; they add up to one more than the shortest run that is never missed
LEAST = 50            # words of the shortest run that is deleted
WHITE = " \t\x0b\x0c\r"


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), id, text, and two hashes that tell apart texts of one id."""
    return df.select(F.struct("*").alias("row")).select(
        "row", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).cast("string").alias("text")) \
        .withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


KEY = ("id", "k1", "k2")


def lines_of(text: Column) -> Column:
    """Lines that hold a word, as (place, two hashes, words); ends are trimmed."""
    split = F.split(text, "\n")
    made = F.transform(split, lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(F.btrim(x, F.lit(WHITE))).alias("h"), F.xxhash64(F.lit(1), F.btrim(x, F.lit(WHITE))).alias("h2"),
        F.regexp_count(x, F.lit(NOT_SPACE + "+")).alias("words")))
    return F.filter(made, lambda x: x["words"] > 0)


def fingerprints(docs: DataFrame, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """Selected grams: KEY, at (the line's number), line, g1, g2, left (nearest first) and right lines around."""
    per_doc = docs.groupBy(*KEY).agg(F.first("lines").alias("lines"))  # one shuffle; all windows below keep its partitioning
    line = per_doc.select(*KEY, F.explode("lines").alias("l")).select(*KEY, F.struct("l.pos", "l.h", "l.words").alias("line"), "l.h2")
    doc = Window.partitionBy(*KEY)
    placed = line.withColumn("start", F.coalesce(F.sum("line.words").over(
        doc.orderBy("line.pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = doc.orderBy("start")
    ahead = by.rangeBetween(0, gram - 1)
    grams = placed.withColumns({
        "at": F.row_number().over(by),
        "whole": F.sum("line.words").over(doc) - F.col("start") >= gram,
        "hs": F.collect_list("line.h").over(ahead), "hs2": F.collect_list("h2").over(ahead),
        "left": F.collect_list("line").over(by.rangeBetween(-(reach - 1), -1)),
        "on": F.collect_list("line").over(by.rangeBetween(0, gram + reach - 2))})
    grams = grams.withColumns({"g1": F.xxhash64("hs"), "g2": F.xxhash64("hs2")})
    least = F.min(F.when(F.col("whole"), F.struct("g1", "at"))).over(by.rangeBetween(0, reach - 1))
    chosen = grams.withColumn("right", F.lead("on").over(by)).withColumn("least_at", least["at"])
    picked = chosen.withColumn("picks", F.collect_set("least_at").over(by.rangeBetween(-(reach - 1), 0)))
    return picked.where(F.array_contains("picks", F.col("at"))).select(
        *KEY, "at", "line", "g1", "g2", F.reverse("left").alias("left"), F.coalesce("right", F.slice("left", 1, 0)).alias("right"))


def same_ahead(ours: Column, theirs: Column) -> Column:
    """How many lines of two contexts agree before the first difference."""
    n = F.least(F.size(ours), F.size(theirs))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                      lambda i: F.get(ours, i)["h"] != F.get(theirs, i))
    return F.coalesce(F.get(differ, 0), n)


def steps(lines: Column, sign: int, done: Column) -> Column:
    """The steps of one side after the first ``done``: side, step, way (hash of the lines so far), at, line."""
    way = F.transform(lines, lambda x: x["h"])
    more = F.when(done < F.size(lines), F.sequence(done + 1, F.size(lines))).otherwise(F.array().cast("array<int>"))
    return F.transform(more, lambda d: F.struct(
        F.lit(sign).alias("side"), d.alias("step"), F.xxhash64(F.slice(way, F.lit(1), d)).alias("way"),
        (F.col("at") + sign * d).alias("at"), F.get(lines, d - 1).alias("line")))


def repeated_lines(prints: DataFrame) -> DataFrame:
    """Lines that an earlier occurrence of a fingerprint shares: KEY, at, line."""
    order = F.struct(F.col("id").isNull().alias("late"), *KEY, "at")
    hashes = lambda c: F.transform(c, lambda x: x["h"])
    first = saved(prints.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(
        order.alias("order"), hashes("left").alias("left"), hashes("right").alias("right"))).alias("first")).where("n > 1"), "repeated-fingerprints")
    # merge joins at every size: neither side is bounded, and AQE splits a hot fingerprint
    pairs = prints.join(first.select(F.col("g1").alias("f1"), F.col("g2").alias("f2"), "n", "first").hint("merge"),
                        (F.col("g1") == F.col("f1")) & (F.col("g2") == F.col("f2"))).where(order != F.col("first.order"))
    reach = pairs.withColumns({"back": same_ahead(F.col("left"), F.col("first.left")), "on": same_ahead(F.col("right"), F.col("first.right"))})
    numbered = lambda c, sign, base: F.transform(c, lambda x, i: F.struct((F.col("at") + sign * (i + base)).alias("at"), x.alias("line")))
    run = F.concat(F.array(F.struct("at", "line")), F.slice(numbered("left", -1, 1), F.lit(1), F.col("back")),
                   F.slice(numbered("right", 1, 1), F.lit(1), F.col("on")))
    sure = F.transform(run, lambda x: F.struct(F.lit(None).cast("int").alias("side"), F.lit(None).cast("int").alias("step"),
                                               F.lit(None).cast("long").alias("way"), x["at"].alias("at"), x["line"].alias("line")))
    # whoever shares a step past the parting from the first occurrence parts from it at the same place, so all of them are here
    asked = F.when(F.col("n") > 2, F.concat(steps(F.col("left"), -1, F.col("back")), steps(F.col("right"), 1, F.col("on"))))
    rows = saved(reach.select(*KEY, "g1", "g2", F.col("at").alias("from"), F.explode(F.concat(sure, F.coalesce(asked, F.slice(sure, 1, 0)))).alias("s"))
                 .select(*KEY, "from", "s.*", *[F.when(F.col("s.side").isNotNull(), F.col(g)).alias(g) for g in ("g1", "g2")]), "matched-lines")
    open_steps = rows.where("side IS NOT NULL").withColumn("order", F.struct(F.col("id").isNull().alias("late"), *KEY, "from"))
    node = ("g1", "g2", "side", "step", "way")
    earliest = open_steps.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first")).where("n > 1")
    shared = open_steps.join(earliest.hint("merge"), list(node)).where(F.col("order") != F.col("first"))
    return rows.where("side IS NULL").select(*KEY, "at", "line").unionByName(shared.select(*KEY, "at", "line"))


def deletions(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """Places of the lines to delete per document: runs of consecutive matched lines of enough words."""
    by = Window.partitionBy(*KEY).orderBy("at")
    islands = lines.withColumns({"island": F.col("at") - F.dense_rank().over(by), "again": F.lag("at").over(by).eqNullSafe(F.col("at"))})
    runs = islands.where(~F.col("again")).groupBy(*KEY, "island").agg(
        F.sum("line.words").alias("words"), F.collect_list("line.pos").alias("places")).where(F.col("words") >= least)
    return runs.groupBy(*KEY).agg(F.flatten(F.collect_list("places")).alias("places"), F.sum("words").alias("removed_words"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, reach: int = REACH,
               least: int = LEAST) -> DataFrame:
    """row (the input's columns as a struct), new_text, removed_lines, removed_words."""
    docs = keyed(df, id_col, text_col)
    prints = saved(fingerprints(docs.where("text IS NOT NULL").select(*KEY, lines_of(F.col("text")).alias("lines")), gram, reach), "fingerprints")
    gone = saved(deletions(repeated_lines(prints), least), "deleted-lines").select(
        F.col("id").alias("d_id"), F.col("k1").alias("d1"), F.col("k2").alias("d2"), "places", "removed_words")
    joined = docs.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("d_id")) & (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("places"))
    rest = F.transform(F.array(split), lambda s: F.array_join(F.transform(kept, lambda i: F.get(s, i)), "\n"))[0]
    return joined.select("row", F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias("new_text"),
                         F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("removed_lines"),
                         F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"))

"""Line-run deduplication by winnowing over line hashes, with DataFrame functions only.

1. A text is its non-blank lines, each a 64-bit hash of the trimmed line.  From each line on, a window takes
   the fewest lines that hold ``words`` words together, and so does a window up from each line.  The
   window's least line hash is its fingerprint.  A window depends on its lines alone, so two texts that
   share a run of at least ``words`` words share every window in it, and with it the fingerprint's place.
2. Positions are joined by fingerprint: windows whose fingerprint stands at one place only are in no
   repeated run and go no further.
3. A place may match others by its fingerprint and not all around it, and each of them to another extent.  So a
   match is extended over its whole window on both sides at once: windows with the same lines are compared with
   the first place (smallest id, then line) of these lines, which shares the whole of them.
4. Matched windows that stand later are put together where they meet, and are deleted.  The windows of a run
   cover it: a line that opens no window in the run either closes one, or lies in the last that opens.  Only
   two neighbouring lines of ``words`` words each lie in no window together; they make a window of their own,
   for the blank lines between them.

So exactly those lines go that lie in a run of at least ``words`` words which stands at an earlier place too,
with the blank lines inside the run.  Runs are judged by the texts as they come in, not by what is left.

Hot lines cost one row each: every window is compared with a first place, never with all others.  The
joins are merge joins at every size: both sides grow with the texts, and hot keys can be split.

Null and blank texts have no lines and stay as they are.  A text may lose all its lines; its row stays
with the empty text.  Rows that repeat an id with an equal text are treated alike (as one place).  Rows with
a null id come after all others, each a place of its own in the order of reading.  An empty table gives no
rows.  A column of the input that is called like the count keeps its name, and the count is not added.
Line ends are line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Places of rows without an id come after this one.
LAST = (1 << 62)


def placed(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``__doc``, the order of places: the id, or a number of its own for a row without one.

    Such numbers hold for one evaluation only, so these rows (and no others) are written once.
    """
    own = F.col(id_col).cast("long")
    known = docs.where(own.isNotNull()).withColumn("__doc", own)
    lost = written(docs.where(own.isNull()).withColumn("__doc", F.lit(LAST) + F.monotonically_increasing_id()), "no-id")
    return known.unionByName(lost)


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc, th, p, h, w``: the non-blank lines with their number, hash and words."""
    split = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("p", "line")
    rows = docs.where(F.length(text_col) > 0).select(F.col("__doc").alias("doc"), F.xxhash64(text_col).alias("th"), split)
    counted = rows.select("doc", "th", "p", F.xxhash64(F.trim("line")).alias("h"), F.regexp_count("line", F.lit(r"\S+")).alias("w")).where("w > 0")
    return counted.dropDuplicates(["doc", "th", "p"])


def windows(lines: DataFrame, words: int) -> DataFrame:
    """The windows of every line: ``doc, th, keys`` with ``key`` (of all lines), ``fp, fp_p`` (the least hash and its line), ``lo_p, hi_p``."""
    own = W.partitionBy("doc", "th")
    placed = lines.withColumn("end", F.sum("w").over(own.orderBy("p").rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.col("end") - F.col("w"))
    by_start, by_end = own.orderBy("at"), own.orderBy("end")
    ahead, behind = by_start.rangeBetween(0, words - 1), by_end.rangeBetween(1 - words, 0)
    line = F.struct("h", "p")
    seen = placed.select(
        "*",
        F.xxhash64(F.lit(0), F.collect_list("h").over(ahead)).alias("down"),
        F.min(line).over(ahead).alias("down_fp"),
        F.max("p").over(ahead).alias("down_p"),
        (F.max("end").over(ahead) - F.col("at") >= words).alias("down_ok"),
        F.lead("p").over(by_start).alias("next_p"),
        F.xxhash64(F.lit(2), "h", F.lead("h").over(by_start)).alias("both"),
        F.least(line, F.struct(F.lead("h").over(by_start).alias("h"), F.lead("p").over(by_start).alias("p"))).alias("both_fp"),
        ((F.col("w") >= words) & (F.lead("w").over(by_start) >= words)).alias("both_ok"),
    ).select(
        "*",
        F.xxhash64(F.lit(1), F.collect_list("h").over(behind)).alias("up"),
        F.min(line).over(behind).alias("up_fp"),
        F.min("p").over(behind).alias("up_p"),
        (F.col("end") - F.min("at").over(behind) >= words).alias("up_ok"),
    )
    key = lambda ok, k, lo, hi: F.when(F.col(ok), F.struct(F.col(k).alias("key"), F.col(f"{k}_fp.h").alias("fp"), F.col(f"{k}_fp.p").alias("fp_p"), F.col(lo).alias("lo_p"), F.col(hi).alias("hi_p")))
    # a window of one line is the same up and down
    up = F.when(F.col("up_p") < F.col("p"), key("up_ok", "up", "up_p", "p"))
    return seen.select("doc", "th", F.array_compact(F.array(key("down_ok", "down", "p", "down_p"), up, key("both_ok", "both", "p", "next_p"))).alias("keys")).where(F.size("keys") > 0)


def repeated_runs(docs: DataFrame, *, words: int = 50, text_col: str = "text") -> DataFrame:
    """Later places of repeated runs: ``doc, th, runs`` with the first and last line of each run (``docs``: ``placed``)."""
    marks = written(windows(lines_of(docs, text_col), words), "windows").select("doc", "th", F.inline("keys"))
    at = F.struct("doc", "th", "fp_p")
    repeated = marks.groupBy("fp").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("fp")
    some = written(marks.join(repeated.hint("merge"), "fp", "left_semi"), "matches")
    first = some.groupBy("key").agg(F.min(F.struct("doc", "th", "lo_p")).alias("f"), F.count("*").alias("c")).where("c > 1")
    first = written(first.select("key", F.col("f.doc").alias("doc0"), F.col("f.th").alias("th0"), F.col("f.lo_p").alias("p0")), "first-windows")
    spans = some.join(first.hint("merge"), "key").where("doc != doc0 or th != th0 or lo_p != p0").select("doc", "th", "lo_p", "hi_p")
    # spans that share a line are one run
    own = W.partitionBy("doc", "th").orderBy("lo_p", "hi_p")
    opened = spans.withColumn("new", (F.col("lo_p") > F.coalesce(F.max("hi_p").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc", "th", "run").agg(F.min("lo_p").alias("lo_p"), F.max("hi_p").alias("hi_p"))
    return runs.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("lo_p", "hi_p"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, words: int = 50, id_col: str = "doc_id", text_col: str = "text", count_col: str = "removed_lines") -> DataFrame:
    """``docs`` with the later repeated runs deleted from the text, and ``count_col``."""
    # names that no column of the input can have by accident
    rows = placed(docs, id_col)
    runs = written(repeated_runs(rows, words=words, text_col=text_col), "line-runs")
    keyed = rows.withColumn("__th", F.xxhash64(text_col))
    joined = keyed.join(runs.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("runs").alias("__runs")).hint("merge"), ["__doc", "__th"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    inside = lambda i: F.exists("__runs", lambda r: (i >= r["lo_p"]) & (i <= r["hi_p"]))
    kept = F.filter(lines, lambda x, i: ~inside(i))
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__runs").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    counted = {} if count_col in docs.columns else {count_col: removed}
    return joined.withColumns({text_col: text, **counted}).select(*docs.columns, *counted)

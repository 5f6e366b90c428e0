"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.common import hash128, join_few, key_bitmap, maybe_in, replaced, spool

MIN_WORDS = 50


def normal_line(line: Column) -> Column:
    """A line as it is compared: runs of blanks as one space, none at the ends."""
    return F.btrim(F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " "))


def line_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows of lines of ``docs(id, place, text)``: place, id, first, last, ``fingerprint``, its position, content hash.

    From each line the shortest run of lines with ``min_words`` words onwards, and to each line the
    shortest run with ``min_words`` words up to it; blank lines do not count. The fingerprint of a
    window is its smallest line hash. Any run of ``min_words`` words that two places share contains
    a whole window, the same one in both, so they share its fingerprint.
    """
    text = F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")
    lines = docs.select("place", "id", F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(
        "place", "id", "pos", F.btrim("raw").alias("line")
    )
    lines = lines.where("line <> ''").select(
        "place", "id", "pos",
        *[h.alias(n) for h, n in zip(hash128(F.col("line")), ("h", "g"))],
        (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"),
    )
    doc = Window.partitionBy("place")
    ends = F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("words"))
    onwards = doc.orderBy("begin").rangeBetween(0, min_words - 1)
    upto = doc.orderBy("end").rangeBetween(1 - min_words, 0)

    def window(frame, whole: Column) -> Column:
        return F.when(
            whole,
            F.struct(
                F.min("pos").over(frame).alias("first"),
                F.max("pos").over(frame).alias("last"),
                F.min(F.struct("h", "pos")).over(frame).alias("low"),
                F.xxhash64(F.collect_list("h").over(frame)).alias("c"),
                F.xxhash64(F.collect_list("g").over(frame)).alias("d"),
            ),
        )

    total = F.max("end").over(doc)
    both = lines.select(
        "place", "id",
        window(onwards, total - F.col("begin") >= min_words).alias("a"),
        window(upto, F.col("end") >= min_words).alias("b"),
    )
    # A window found both ways at one line (a long line) is listed once.
    twice = (F.col("a.first") == F.col("b.first")) & (F.col("a.last") == F.col("b.last"))
    found = F.array_compact(F.array("a", F.when(~F.coalesce(twice, F.lit(False)), F.col("b"))))
    return both.select("place", "id", F.explode(found).alias("w")).select(
        "place", "id", "w.first", "w.last", F.col("w.low.h").alias("fingerprint"), F.col("w.low.pos").alias("at"), "w.c", "w.d"
    )


def repeated_positions(windows: DataFrame) -> DataFrame:
    """``place, gone``: sorted line positions covered by windows whose content occurred earlier.

    Fingerprints that occur at one position only are left out: those of several positions, found by
    a grouped count, are marked in a bitmap (a few others pass by chance and find no partner). The
    windows of the rest are joined by content with their first occurrence in the order (id, place,
    line). The windows before and after a matched one extend it both ways to the whole repeated run:
    each line of a run of ``min_words`` words or more is in a window that lies in the run.
    """
    several = (
        windows.groupBy("fingerprint")
        .agg(F.min("place").alias("p"), F.max("place").alias("q"), F.min("at").alias("a"), F.max("at").alias("b"))
        .where("p <> q OR a <> b")
    )
    matched = spool(maybe_in(windows, "fingerprint", key_bitmap(several, "fingerprint")).drop("fingerprint", "at"), "line-matches")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "place", "first")
    firsts = spool(
        matched.groupBy("c", "d").agg(F.min(order).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "line-firsts",
    )
    later = matched.join(firsts.hint("merge"), ["c", "d"]).where(
        (F.col("place") != F.col("origin.place")) | (F.col("first") != F.col("origin.first"))
    )
    gone = later.select("place", F.explode(F.sequence("first", "last")).alias("pos"))
    return gone.groupBy("place").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the sorted positions ``gone``: the stretches between them are joined."""
    lines = F.split(text, "\n")

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.coalesce(F.get(gone, i), F.size(lines))
        return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch)), "\n")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    lines_col: str = "n_lines",
    gone_col: str = "n_deleted",
) -> DataFrame:
    """``docs`` with later repeats of line runs taken out of the text, plus the numbers of lines and of deleted lines.

    A run of consecutive lines (blank ones aside) with ``min_words`` words or more is deleted where
    the same run stands earlier, in a document with a smaller id or further up in the same one. The
    first occurrence of every line stays. Shorter repeats stay. Blank lines inside a deleted run go with it.
    Lines are compared whole: a passage of any length that does not begin and end with lines stays.

    Lines of one document meet in one task (a document is the unit); fingerprints are counted with
    partial aggregation, and the join on content has its frequent values on a side that the adaptive
    planner splits. Nothing pairs up the places that share a run. Texts that lose no line are not
    shuffled.

    Defined cases: null text stays null with 0 lines; a text without words stays as it is; null ids
    come after all others; rows with equal ids (repeated rows too) come in scan order; an empty
    table gives an empty result; all other columns are passed through, an existing ``n_lines`` or
    ``n_deleted``, in any case, is replaced. ``docs`` must be deterministic (a table or files): its texts are read
    twice.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    windows = spool(
        line_windows(rows.select("place", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text")), min_words),
        "line-windows",
    )
    marks = spool(repeated_positions(windows), "line-gone")
    text = F.col(f"row.`{text_col}`")
    joined = join_few(rows, marks, "place", "left")
    kept = F.when(F.col("gone").isNull(), text).otherwise(without_lines(text, F.col("gone")))
    new = {
        lines_col: F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"),
        gone_col: F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    found = joined.select(F.col("row").withField(f"`{text_col}`", kept).alias("row"), *(v.alias(f"_{i}") for i, v in enumerate(new.values())))
    return found.select(*replaced("row", docs.columns, {n: F.col(f"_{i}") for i, n in enumerate(new)}))

"""Line deduplication: repeated runs of lines by a suffix array over line ids.

Every document is the sequence of the ids of its lines that are not blank. Suffixes are ranked
by distributed prefix doubling: rank k orders all suffixes by their first 2**k lines, rank k+1
comes from the pair (rank k here, rank k 2**k lines on). Suffixes that share a prefix of m lines
form an interval of the suffix array with a longest common prefix of at least m; with
2**k <= m < 2**(k+1) they are the ones with equal (rank k at the start, rank k at m - 2**k).

A run is repeated if it has ``min_words`` words at least and stands somewhere before, in the
order of (doc_id, row, line). Any repeated run is covered by its shortest stretches of
``min_words`` words, taken from every start and to every end, and each of these is repeated as
well. So two intervals per line decide, and since a line has a word at least, no depth beyond
``min_words`` lines is needed. In every interval the first copy stays and the lines of the
others are deleted; where a copy overlaps the first one, its lines beyond that are.

Lines that occur once cannot be part of a run and leave the work at the start. A line that
fills a third of the table is one class whose members are ranked in slices; classes are counted
before they are shuffled.

Null text counts as empty: one blank line, nothing deleted. Blank lines are no part of a run;
those between two deleted lines go with them. Null doc_ids come first. ``docs`` is scanned
once: its rows are numbered and written, and both the lines and the texts are read from there,
so a span belongs to its row whatever partitions a scan is planned in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.common import cut, number_rows

MIN_WORDS = 50
SLICE_BITS = 10           # first ranking: slices by the id's top bits
SLICE = 512               # later rankings: least width of a slice of ranks
NO_ID = -(1 << 63)
ROW = "__line_row"


def line_ids(numbered: DataFrame) -> DataFrame:
    """row, doc, i (place among the document's lines that are not blank), no (line number from
    0), id, words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = numbered.select(
        F.col(ROW).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.posexplode(F.split(text, "\n")).alias("no", "line")).where(F.trim("line") != "")
    lines = lines.select("row", "doc", "no", F.xxhash64("line").alias("id"),
                         F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("words"))
    return lines.where("words > 0")


def repeated_lines(numbered: DataFrame) -> DataFrame:
    """The lines whose id occurs more than once, with ``i`` and the number n of the class."""
    lines = cut(line_ids(numbered))
    counts = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    i = F.row_number().over(Window.partitionBy("row").orderBy("no"))
    placed = lines.withColumn("i", i)
    return cut(placed.join(counts, "id"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """``lines`` plus rank: the number of lines with a smaller id."""
    ids = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "slice", F.shiftrightunsigned("id", 64 - SLICE_BITS))
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    slices = ids.groupBy("slice").agg(F.sum("n").alias("m")).select(
        "slice", F.coalesce(F.sum("m").over(before().orderBy("slice")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before("slice").orderBy("id")), F.lit(0))
    ranks = ids.withColumn("inside", inside).join(slices, "slice").select(
        "id", (F.col("start") + F.col("inside")).alias("rank"))
    return lines.join(ranks, "id")


def refine(suffixes: DataFrame, step: int, width: int) -> DataFrame:
    """rank, n of the suffixes by twice as many lines. ``suffixes``: row, i, rank, n and others.
    A class holds the ranks from its own on, one for each member, so a member's new rank is the
    class's plus the number of members whose next part is smaller."""
    ahead = Window.partitionBy("row").orderBy("i").rangeBetween(step, step)
    paired = cut(suffixes.withColumn("next", F.coalesce(F.first("rank").over(ahead), F.lit(-1))))
    # classes of more than ``width`` members are summed slice by slice
    part = F.when(F.col("n") > width, F.floor(F.col("next") / width)).otherwise(F.lit(0))
    pairs = paired.groupBy("rank", "next").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("m")).withColumn("part", part)
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("m").over(before("rank", "part").orderBy("next")), F.lit(0))
    parts = pairs.where(F.col("n") > width).groupBy("rank", "part").agg(F.sum("m").alias("pm"))
    parts = parts.select(F.col("rank").alias("r"), F.col("part").alias("p"), F.coalesce(
        F.sum("pm").over(before("rank").orderBy("part")), F.lit(0)).alias("start"))
    ranks = pairs.withColumn("inside", inside).join(
        parts, (F.col("rank") == F.col("r")) & (F.col("part") == F.col("p")), "left").select(
        F.col("rank").alias("old"), F.col("next").alias("old_next"), F.col("m").alias("new_n"),
        (F.col("rank") + F.coalesce("start", F.lit(0)) + F.col("inside")).alias("new"))
    return paired.join(ranks, (F.col("rank") == F.col("old")) & (F.col("next") == F.col("old_next"))
                       ).drop("old", "old_next", "next", "rank", "n").withColumnsRenamed(
        {"new": "rank", "new_n": "n"})


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """row, doc, a, b: the shortest stretches of lines with ``min_words`` words from every start
    and to every end, inside gapless runs of repeated lines."""
    run = F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i"))
    grouped = lines.select("row", "doc", "i", "words", run.alias("run"))
    up_to = F.sum("words").over(Window.partitionBy("row", "run").orderBy("i"))
    ends = grouped.withColumn("end", up_to).withColumn("start", F.col("end") - F.col("words"))

    def nearest(of: str, asked: Column, up: bool) -> DataFrame:
        """Per line, the nearest line whose ``of`` is at least (at most) ``asked``."""
        both = ends.select("row", "doc", "run", "i", F.explode(F.array(
            F.struct(F.col(of).alias("v"), F.lit(1).alias("line")),
            F.struct(asked.alias("v"), F.lit(0).alias("line")))).alias("e")).select(
            "row", "doc", "run", "i", "e.v", "e.line")
        order = [F.desc("v"), F.desc("line"), F.desc("i")] if up else ["v", F.desc("line"), "i"]
        last = F.last(F.when(F.col("line") == 1, F.col("i")), ignorenulls=True).over(
            Window.partitionBy("row", "run").orderBy(*order))
        return both.withColumn("hit", last).where("line = 0 and hit is not null")

    forward = nearest("end", F.col("start") + min_words, True).select(
        "row", "doc", F.col("i").alias("a"), F.col("hit").alias("b"))
    backward = nearest("start", F.col("end") - min_words, False).select(
        "row", "doc", F.col("hit").alias("a"), F.col("i").alias("b"))
    return forward.unionByName(backward).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``runs_of`` for rows that have no number yet."""
    return runs_of(number_rows(docs, ROW), min_words)


def runs_of(numbered: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(lines, copies). copies: row, a, b of every stretch that stands somewhere before, with
    row0, a0 of its first copy; lines: the repeated lines."""
    lines = repeated_lines(numbered)
    spans = cut(stretches(lines, min_words))
    longest = spans.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] or 1
    members = lines.count()
    width = max(SLICE, int(members ** 0.5))
    ranked = cut(first_ranks(lines.select("row", "i", "id", "n")).drop("id"))
    m = F.col("b") - F.col("a") + 1
    found = None
    for k in range(longest.bit_length()):
        if k:
            ranked = cut(refine(ranked, 1 << (k - 1), width))
        now = spans.where((m >= 1 << k) & (m < 2 << k)).withColumn(
            "tail", F.col("b") - (1 << k) + 1)
        at = ranked.select("row", "i", "rank", "n")
        head = at.where("n > 1").select("row", F.col("i").alias("a"), F.col("rank").alias("rank_a"))
        tail = at.where("n > 1").select("row", F.col("i").alias("tail"), F.col("rank").alias("rank_b"))
        now = cut(now.join(head, ["row", "a"]).join(tail, ["row", "tail"]).withColumn("m", m))
        interval = ["m", "rank_a", "rank_b"]
        first = now.groupBy(*interval).agg(F.min(F.struct("doc", "row", "a")).alias("f")).select(
            *[F.col(c).alias("_" + c) for c in interval], F.col("f.row").alias("row0"),
            F.col("f.a").alias("a0"))
        same = [F.col(c) == F.col("_" + c) for c in interval]
        later = now.join(first, same[0] & same[1] & same[2]).where(
            (F.col("row") != F.col("row0")) | (F.col("a") != F.col("a0"))).select(
            "row", "a", "b", "m", "row0", "a0")
        found = later if found is None else found.unionByName(later)
    return lines, found


def deleted_spans(numbered: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, spans (array of first and last line number, ascending), deleted lines that are not
    blank."""
    lines, copies = runs_of(numbered, min_words)
    own_end = F.col("a0") + F.col("m") - 1
    start = F.when((F.col("row") == F.col("row0")) & (F.col("a") <= own_end), own_end + 1
                   ).otherwise(F.col("a"))
    gone = copies.withColumn("from", start).where("from <= b").select(
        "row", F.explode(F.sequence("from", "b")).alias("i")).distinct()
    gone = gone.join(lines.select("row", "i", "no"), ["row", "i"])
    island = F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i"))
    spans = gone.withColumn("island", island).groupBy("row", "island").agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.count(F.lit(1)).alias("lines"))
    return spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"),
        F.sum("lines").alias("deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """``docs`` with later copies of repeated runs taken out of ``text``, all other columns as
    they are. ``report`` adds line_spans, lines_before and lines_deleted (columns of these names
    in the input give way)."""
    numbered = number_rows(docs, ROW)
    spans = cut(deleted_spans(numbered, min_words)).select(
        F.col("row").alias("__line_row2"), F.col("spans").alias("__line_spans"),
        F.col("deleted").alias("__line_deleted"))
    span, lines = F.col("__line_spans"), F.col("__line_all")
    gaps = F.transform(F.sequence(F.lit(0), F.size(span)), lambda k: F.struct(
        F.when(k == 0, F.lit(0)).otherwise(F.get(span, k - 1)["last"] + 1).alias("start"),
        F.when(k == F.size(span), F.size(lines)).otherwise(F.get(span, k)["first"]).alias("stop")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["start"] + 1,
                                                        g["stop"] - g["start"])))
    joined = numbered.join(spans, F.col(ROW) == F.col("__line_row2"), "left").withColumn(
        "__line_all", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    text = F.when(span.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    more = {"line_spans": span, "lines_before": F.size(lines).cast("long"),
            "lines_deleted": F.coalesce(F.col("__line_deleted"), F.lit(0))} if report else {}
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in more],
        *[c.alias(n) for n, c in more.items()])

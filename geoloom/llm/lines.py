"""Operator 9: repeated line runs from a suffix array built by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sieve import sift
from .storage import discard, materialize

MOST_BUCKETS = 20_000


def _rank(keys: DataFrame, first, total: int, heavy=None, second=None) -> DataFrame:
    """``keys(a, b, n)`` with ``rank``: how many positions have a smaller (a, b).

    Keys are dealt by the order itself into buckets of about total / buckets positions, and summed within and
    then over buckets; a first component that alone fills a bucket is dealt on by the second.
    """
    width = max(512, -(-total // MOST_BUCKETS))
    x = first(width)
    y = F.when(heavy > width, second(width)).otherwise(F.lit(-1).cast("long")) if heavy is not None else F.lit(-1).cast("long")
    dealt = keys.withColumns({"_x": x, "_y": y})
    inside = Window.partitionBy("_x", "_y").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_x", "_y").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BUCKETS rows or so
    sums = dealt.groupBy("_x", "_y").agg(F.sum("n").alias("_s"))
    offsets = sums.select("_x", "_y", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_offset"))
    return (
        dealt.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, ["_x", "_y"])
        .select("a", "b", "n", (F.col("_offset") + F.col("_before")).alias("rank"))
    )


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that aren't blank: ``_id, _doc, _j`` (dense), ``_i`` (as in the text), ``_words, _hash, _size``."""
    text = F.col(text_col).cast("string")
    numbered = F.transform(F.split(text, "\n"), lambda l, i: F.struct(i.alias("i"), F.trim(F.translate(l, "\t\r", "  ")).alias("l")))
    lines = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("_doc"),
        F.posexplode(F.filter(numbered, lambda x: x["l"] != "")).alias("_j", "_line"),
    )
    line = F.col("_line.l")
    return lines.select(
        "_id", "_doc", "_j", F.col("_line.i").alias("_i"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("_words"),
        F.xxhash64(line).alias("_hash"), F.length(line).cast("long").alias("_size"),
    )


def suffix_ranks(lines: DataFrame, most_lines: int) -> tuple[DataFrame, int]:
    """Prefix doubling: ``_ranks[k]`` orders a position's next 2**k lines among all positions.

    Positions whose prefix is unique drop out at each step, since no repeat starts there; the rest is the part of the
    suffix array that matters, in the order of the last rank.  A rank names the interval of suffixes that share
    their first 2**k lines.  Steps stop at windows of ``most_lines`` lines, beyond which longer runs are unions.
    """
    seen = lines.groupBy(F.col("_hash").alias("a"), F.col("_size").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    seen = materialize(seen, "lines-seen")
    total = seen.agg(F.sum("n")).first()[0] or 0

    def spread(width):
        buckets = max(1, total // width)
        return F.floor((F.col("a").cast("double") / 2.0**64 + 0.5) * buckets)

    ranked = _rank(seen, spread, total)
    at = lines.join(ranked.select(F.col("a").alias("_hash"), F.col("b").alias("_size"), "n", "rank"), ["_hash", "_size"]).select(
        "_id", "_doc", "_j", "_i", "_words", F.array("rank").alias("_ranks"), F.col("rank").alias("_r"), F.col("n").alias("_n")
    )
    at, step = materialize(at, "lines-0"), 1
    discard(seen)
    held = at
    while total and step * 2 <= most_lines:
        order = Window.partitionBy("_doc").orderBy("_j")
        behind = F.when(F.lead("_j", step).over(order) == F.col("_j") + step, F.lead("_r", step).over(order))
        paired = at.withColumn("_b", F.when(F.col("_r").isNotNull(), behind))
        keys = paired.where("_b is not null").groupBy(F.col("_r").alias("a"), F.col("_b").alias("b")).agg(
            F.count("*").alias("n"), F.max("_n").alias("_heavy")
        ).where("n > 1")
        keys = materialize(keys, "lines-keys")
        total = keys.agg(F.sum("n")).first()[0] or 0
        if not total:
            discard(keys)
            break
        near = lambda c: lambda width: F.floor(F.col(c) / width)
        ranked = _rank(keys, near("a"), total, F.col("_heavy"), near("b"))
        ranked = ranked.select(F.col("a").alias("_r"), F.col("b").alias("_b"), F.col("n").alias("_n"), F.col("rank").alias("_next"))
        at = paired.drop("_n").join(ranked, ["_r", "_b"], "left").select(
            "_id", "_doc", "_j", "_i", "_words", F.concat("_ranks", F.array("_next")).alias("_ranks"), F.col("_next").alias("_r"), "_n"
        )
        step *= 2
        old, at = held, materialize(at, f"lines-{step}")
        discard(old, keys)
        held = at
    return at, step


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """``(_doc, _removed)``: for each document the numbers of its lines that belong to a later copy of a run.

    A run is a maximal sequence of consecutive lines of one document, blank lines aside, that occurs at an
    earlier place too (smaller id, or earlier in the same document) and has ``least_words`` words in all.  Its
    lines are exactly those of its shortest sub-runs of that many words, from a line on or up to a line.  Each
    of these has at most ``least_words`` lines, so it is named by two ranks that overlap: the interval of
    suffixes with that common prefix.  The earliest member stays and the lines of later ones go.
    """
    # texts are split once; rows of equal id and text are one document, so each of its lines counts once
    lines = materialize(line_rows(docs, id_col, text_col).dropDuplicates(["_doc", "_j"]), "lines")
    at, _ = suffix_ranks(lines, least_words)
    discard(lines)
    order = Window.partitionBy("_doc").orderBy("_j")
    isle = at.select("_id", "_doc", "_j", "_words", "_ranks", (F.col("_j") - F.row_number().over(order)).alias("_isle"))
    part = Window.partitionBy("_doc", "_isle").orderBy("_j")
    isle = isle.withColumn("_upto", F.sum("_words").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    isle = isle.withColumn("_from", F.col("_upto") - F.col("_words"))
    ahead = F.collect_list("_upto").over(part.rowsBetween(0, least_words - 1))
    back = F.collect_list("_from").over(part.rowsBetween(-(least_words - 1), 0))
    spans = isle.select("_id", "_doc", "_j", "_upto", "_from", ahead.alias("_ahead"), back.alias("_back"))
    forward = 1 + F.size(F.filter("_ahead", lambda c: c < F.col("_from") + least_words))
    backward = 1 + F.size(F.filter("_back", lambda c: c > F.col("_upto") - least_words))
    runs = spans.select(
        "_id", "_doc",
        F.explode(F.array(
            F.when(forward <= F.size("_ahead"), F.struct(F.col("_j").alias("at"), forward.alias("n"))),
            F.when(backward <= F.size("_back"), F.struct((F.col("_j") - backward + 1).alias("at"), backward.alias("n"))),
        )).alias("_run"),
    ).where("_run is not null").select("_id", "_doc", F.col("_run.at").alias("_j"), F.col("_run.n").alias("_len")).distinct()
    level = F.floor(F.log2(F.col("_len").cast("double")) + 1e-9).cast("int")
    runs = runs.withColumn("_k", level).withColumn("_j2", F.col("_j") + F.col("_len") - F.expr("shiftleft(1, _k)"))
    ranks = at.select("_doc", "_j", "_ranks")
    named = (
        runs.join(ranks, ["_doc", "_j"]).withColumn("_p", F.get("_ranks", F.col("_k"))).drop("_ranks").where("_p is not null")
        .join(ranks.withColumnRenamed("_j", "_j2"), ["_doc", "_j2"]).withColumn("_q", F.get("_ranks", F.col("_k"))).drop("_ranks")
        .where("_q is not null").withColumn("_place", F.struct("_id", "_doc", "_j"))
    )
    named = materialize(named, "line-runs")
    first = named.groupBy("_len", "_p", "_q").agg(F.min("_place").alias("_first"), F.count("*").alias("_many")).where("_many > 1").drop("_many")
    first = materialize(first, "line-firsts")  # so that the join deals both sides itself and can split a hot run
    later = named.join(first, ["_len", "_p", "_q"]).where("_place <> _first")
    gone = later.select("_doc", F.explode(F.sequence(F.col("_j"), F.col("_j") + F.col("_len") - 1)).alias("_j")).distinct()
    numbers = gone.join(at.select("_doc", "_j", "_i"), ["_doc", "_j"])
    removed = materialize(numbers.groupBy("_doc").agg(F.sort_array(F.collect_set("_i")).alias("_removed")), "removed-lines")
    discard(at, named, first)
    return removed


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from the text, and ``removed_lines`` (their numbers).

    See :func:`repeated_lines`.  Words are counted by the spaces between them; lines compare without the white
    space at their ends, by a 64-bit hash and their length.  Other columns pass through; a column named
    ``removed_lines`` is replaced.  Null texts stay null and blank ones stay as they are.  Rows with equal id and
    text are one document; a null id sorts before all others; an empty table stays empty.  A line that a third
    of all documents share is one key of pre-aggregated counts and of joins that adaptive execution splits.

    Only texts that may have lines to be cut are dealt by document; a bitmap of these documents, of fixed size, lets all others
    pass where they are.
    """
    keep = [c for c in docs.columns if c != "removed_lines"]
    removed = repeated_lines(docs, id_col=id_col, text_col=text_col, least_words=least_words)
    packed = docs.select(F.struct(*keep).alias("_row"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_doc"))
    some, whole = sift(packed, F.col("_doc"), removed, F.col("_doc"))
    none = F.array().cast("array<int>")

    def out(rows: DataFrame, text, gone) -> DataFrame:
        return rows.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in keep], gone.alias("removed_lines"))

    text = F.col("_row").getField(text_col).cast("string")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda l, i: ~F.array_contains("_removed", i)), "\n")
    cut = out(some.join(removed, "_doc", "left"), F.when(F.col("_removed").isNull(), text).otherwise(rest), F.coalesce("_removed", none))
    return cut.unionAll(out(whole, text, none))

"""Ordered-row operators over headings and blocks: sections, ids, numbers, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import alpha_label
from quillgrid.sources.shared import by_key

UP = (Window.unboundedPreceding, -1)
#: Heading levels.
LEVELS = range(1, 7)


def doc_order(*keys: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(keys or ("node_id",)))


def last_of_levels(value: Column | str, w: Window, level: str = "level") -> list[Column]:
    """For each heading level, the value of its last row in the frame: a conditional ``last``, so a row carries seven values at most."""
    return [F.last(F.when(F.col(level) == k, F.col(value) if isinstance(value, str) else value), ignorenulls=True).over(w) for k in LEVELS]


def sections(headings: DataFrame, order: str = "line_no") -> DataFrame:
    """headings plus parent (order of the last heading above with a lower level) and next (order of the heading that ends the section).

    The last heading of each level, upward and downward, decides both: the work is linear in the headings.
    """
    up = doc_order(order).rowsBetween(*UP)
    down = Window.partitionBy("doc_id").orderBy(F.col(order).desc()).rowsBetween(*UP)
    own = F.col("level")
    above = F.array(*[F.when(own > k, x) for k, x in zip(LEVELS, last_of_levels(order, up), strict=True)])
    below = F.array(*[F.when(own >= k, x) for k, x in zip(LEVELS, last_of_levels(order, down), strict=True)])
    return headings.withColumn("parent", F.array_max(above)).withColumn("next", F.array_min(below))


def heading_numbers(headings: DataFrame, least: int = 1, order: str = "line_no") -> DataFrame:
    """headings plus number (1, 1.1, ...): a level above the open ones pops them, an equal one counts on, a deeper one starts at 1.

    A level's figure is its running count less the count that stood at the last heading of a lower level.
    """
    w = doc_order(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = headings.where(F.col("level") >= least)
    counted = rows.withColumn("counts", F.array(*[F.sum((F.col("level") == k).cast("int")).over(w) for k in LEVELS]))
    since = lambda k: F.coalesce(F.last(F.when(F.col("level") < k, F.get("counts", F.lit(k - 1))), ignorenulls=True).over(w), F.lit(0))
    figures = counted.withColumn("figures", F.array(*[F.when(F.col("level") >= k, F.get("counts", F.lit(k - 1)) - since(k)) for k in LEVELS]))
    number = F.array_join(F.transform(F.filter("figures", lambda n: n > 0), lambda n: n.cast("string")), ".")
    return figures.withColumn("number", number).drop("counts", "figures")


def unique_ids(headings: DataFrame, base: str = "slug", order: str = "line_no", reserved: DataFrame | None = None) -> DataFrame:
    """headings plus id: base, base-2, base-3 in document order, numbers that explicit ids (doc_id, id) hold left out.

    The nth heading of a base takes the nth number that is free; 1 stands for the bare base. Only explicit
    ids of the form base or base-n are looked up, by a join on the base.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id", base).orderBy(order))
    rows = headings.withColumn("nth", nth)
    if reserved is None:
        taken = F.array().cast("array<int>")
    else:
        tail = F.regexp_extract("id", r"-([2-9]|[1-9][0-9]+)$", 1)
        bare = reserved.select("doc_id", F.col("id").alias(base), F.lit(1).alias("n"))
        numbered = reserved.where(tail != "").select("doc_id", F.regexp_replace("id", r"-[0-9]+$", "").alias(base), tail.cast("int").alias("n"))
        held = bare.union(numbered).groupBy("doc_id", base).agg(F.collect_set("n").alias("taken"))
        rows = rows.join(by_key(held), ["doc_id", base], "left")
        taken = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.filter(F.sequence(F.lit(1), F.col("nth") + F.size(taken)), lambda n: ~F.array_contains(taken, n))
    n = F.element_at(free, F.col("nth"))
    return rows.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string")))).drop("nth", "taken")


def neighbours(nodes: DataFrame, value: str = "type", order: str = "node_id") -> DataFrame:
    w = doc_order(order)
    return nodes.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def sequence_numbers(items: DataFrame) -> DataFrame:
    """items plus number: the list's start value, then one more each."""
    w = Window.partitionBy("doc_id", "indent", "list_no").orderBy("line_no")
    return items.withColumn("number", F.coalesce(F.first("value").over(w), F.lit(1)) + F.row_number().over(w) - 1)


def level_skips(headings: DataFrame, order: str = "line_no") -> DataFrame:
    """Headings more than one level below the one above."""
    return headings.withColumn("above", F.lag("level").over(doc_order(order))).where("level > above + 1")


def caption_counters(captions: DataFrame) -> DataFrame:
    """captions plus n per counter text, in document order."""
    w = Window.partitionBy("doc_id", "counter").orderBy("node_id")
    return captions.where("counter is not null").withColumn("n", F.row_number().over(w))


def panel_letters(panels: DataFrame, order: str = "node_id") -> DataFrame:
    return panels.withColumn("letter", alpha_label(F.row_number().over(Window.partitionBy("doc_id", "group_id").orderBy(order))))


def first_use_numbers(uses: DataFrame, key: str = "label", order: str = "position") -> DataFrame:
    """doc_id, key, number by first use, and repeat: how often it was used up to each row."""
    first = uses.groupBy("doc_id", key).agg(F.min(order).alias("first_use"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_use", key)))
    return uses.join(by_key(numbered.drop("first_use")), ["doc_id", key]).withColumn("repeat", F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order)))


def blank_runs(classified: DataFrame) -> DataFrame:
    """blanks: how many blank lines stand right before each inked line."""
    w = doc_order("line_no")
    rows = classified.withColumn("island", F.sum((F.col("form") != "blank").cast("int")).over(w))
    counted = rows.groupBy("doc_id", "island").agg(F.sum((F.col("form") == "blank").cast("int")).alias("after"))
    inked = rows.where("form <> 'blank'").select("doc_id", "line_no", (F.col("island") - 1).alias("island"))
    return inked.join(by_key(counted), ["doc_id", "island"], "left").select("doc_id", "line_no", F.coalesce("after", F.lit(0)).alias("blanks"))


def within_budget(rows: DataFrame, text: str, budget: Column, order: str) -> DataFrame:
    """Rows of a document up to the one whose running bytes pass the budget."""
    w = doc_order(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes", F.sum(F.octet_length(text)).over(w)).where(F.col("bytes") <= budget)


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a document, with its total and whether some are left out."""
    w = doc_order(*order)
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("total", F.count("*").over(whole))
    return rows.where(F.col("nth") <= n).withColumn("truncated", F.col("total") > n)

"""Nested blocks: canonical text reads back as the same blocks, and edge cases have defined results."""

import random

from pyspark.sql import functions as F

from quillgrid.operators import nesting as N

LEAVES = ("para", "two\nlines", "# Head", "---", "```py\nx = 1\n\ny\n```", "| a | b |\n| c | d |", ":: t\n: d", "%% note")


def block(r, depth):
    """A random block as lines; holders hold one to three blocks."""
    kind = r.choice(("leaf", "leaf", "quote", "list", "box")) if depth else "leaf"
    if kind == "leaf":
        return r.choice(LEAVES).split("\n")
    if kind == "list":
        mark = r.choice(("- ", "1. "))
        lines = []
        for _ in range(r.randint(1, 3)):
            inner = body(r, depth - 1, first="item")
            lines += [mark + inner[0], *[(" " * len(mark) + x).rstrip() for x in inner[1:]]]
        return lines
    inner = body(r, depth - 1)
    if kind == "quote":
        return [("> " + x).rstrip() for x in inner]
    return [":" * (3 + depth) + " box", *inner, ":" * (3 + depth)]


def body(r, depth, first=None):
    lines = [first] if first else []
    for _ in range(r.randint(1, 3)):
        lines += ([""] if lines else []) + block(r, depth)
    return lines


def test_canonical_text_reads_back_the_same(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(i, "\n".join(body(r, 3))) for i in range(120)], "doc_id long, source string").repartition(4)
    rows = N.nested(docs)
    once = N.render_nested(rows, "canonical").withColumnRenamed("text", "source")
    again = N.nested(once)
    html = N.render_nested(rows).join(N.render_nested(again).withColumnRenamed("text", "later"), "doc_id")
    stable = once.join(N.render_nested(again, "canonical"), "doc_id")
    assert stable.where("source <> text").collect() == []
    assert html.where("text <> later").collect() == []
    assert stable.count() == 120


def test_edge_cases(spark):
    deep = "> " * 12 + "x"
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "\n \n"), (4, deep), (5, ":::\nstray"), (6, "::: box\nopen"), (7, "- a\n\npara\n+\nx"), (8, "```\n::: box\n- a\n```"), (9, "- a\r\n  - b"), (10, "+\n\ntail")],
        "doc_id long, source string",
    )
    docs = docs.withColumn("path", F.lit("clash")).withColumn("node_id", F.lit(1))
    got = {r.doc_id: r.text for r in N.render_nested(N.nested(docs)).collect()}
    assert set(got) == {4, 5, 6, 7, 8, 9, 10}
    assert got[4] == "<blockquote>\n" * 12 + "<p>x</p>" + "\n</blockquote>" * 12
    assert got[5] == "<div>\n<p>stray</p>\n</div>"
    assert got[6] == '<div class="box">\n<p>open</p>\n</div>'
    assert got[7].startswith("<ul>\n<li>a</li>\n</ul>\n<p>para")
    assert got[8] == "<pre><code>::: box\n- a</code></pre>"
    assert got[9] == "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>"


def test_parents_are_paths(spark):
    rows = N.nested(spark.createDataFrame([(1, "- a\n  > b\n- c")], "doc_id long, source string"))
    got = sorted((list(r.path), r.type) for r in rows.collect())
    assert got == [([1], "list_item"), ([1, 1], "paragraph"), ([1, 2], "quote"), ([1, 2, 1], "paragraph"), ([2], "list_item"), ([2, 1], "paragraph")]

"""Queries of nested blocks: lists, quotes and containers that hold blocks, in five targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import nesting as N
from quillgrid.plans.base import query, table
from quillgrid.plans.render_queries import sql_text

#: Shapes by p_partkey % 6; {n} and {t} stand for p_name and p_type.
SHAPES = (
    ("- {n}\n  - {t}\n    - c\n  - [x] d\n- e",
     '<ul>\n<li>{n}\n<ul>\n<li>{t}\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n<ul>\n<li data-task-state="x"><input type="checkbox" checked disabled>d</li>\n</ul>\n</li>\n<li>e</li>\n</ul>',
     "- {n}\n  - {t}\n    - c\n  - [x] d\n- e"),
    ("> > {n}\n>\n> - x\n>\n>   {t}\n> - z\n\ntail",
     "<blockquote>\n<blockquote>\n<p>{n}</p>\n</blockquote>\n<ul>\n<li>\n<p>x</p>\n<p>{t}</p>\n</li>\n<li>\n<p>z</p>\n</li>\n</ul>\n</blockquote>\n<p>tail</p>",
     "> > {n}\n>\n> - x\n>\n>   {t}\n>\n> - z\n\ntail"),
    ('::: note "T"\n{n}\n\n:::: box\n- {t}\n::::\n:::\n\nend',
     '<aside class="admonition note" aria-label="T">\n<p class="admonition-title">T</p>\n<p>{n}</p>\n<div class="box">\n<ul>\n<li>{t}</li>\n</ul>\n</div>\n</aside>\n<p>end</p>',
     '::: note "T"\n{n}\n\n:::: box\n- {t}\n::::\n:::\n\nend'),
    ("3. {n}\n4. two\n\n   ```py\n   1 < 2\n   ```\n+\n> {t}\n\npara\nlazy",
     '<ol start="3">\n<li>{n}</li>\n<li>two\n<pre><code class="language-py">1 &lt; 2</code></pre>\n<blockquote>\n<p>{t}</p>\n</blockquote>\n</li>\n</ol>\n<p>para\nlazy</p>',
     "3. {n}\n4. two\n   ``` py\n   1 < 2\n   ```\n   > {t}\n\npara\nlazy"),
    (":: {n}\n: {t}\n: d\n\n{#i .c}\n# H\n\n%% hidden\n\n> - # I\ntail",
     '<dl>\n<dt>{n}</dt>\n<dd>{t}</dd>\n<dd>d</dd>\n</dl>\n<h1 id="i" class="c">H</h1>\n<blockquote>\n<ul>\n<li>\n<h1>I</h1>\n</li>\n</ul>\n</blockquote>\n<p>tail</p>',
     ":: {n}\n: {t}\n: d\n\n{#i .c}\n# H\n\n%% hidden\n\n> - # I\n\ntail"),
    ("![{n}](b)\n^ {t}\n\n::: |\na\n  b\n:::",
     '<figure>\n<p><img src="b" alt="{n}"></p>\n<figcaption>{t}</figcaption>\n</figure>\n<div class="line-block">a<br>\n&nbsp;&nbsp;b</div>',
     "![{n}](b)\n^ {t}\n\n::: |\na\n  b\n:::"),
)


def named(text: str) -> str:
    return sql_text(text.replace("{n}", "{p_name}").replace("{t}", "{p_type}"))


def by_shape(texts) -> str:
    return "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {named(t)}" for i, t in enumerate(texts)) + " END"


def nested(spark, sf, columns):
    n, t = F.col("n"), F.col("t")
    docs = table(spark, sf, "part").selectExpr("cast(p_partkey as bigint) doc_id", "p_name n", "p_type t")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{n}"), n), F.lit("{t}"), t)
    source = F.coalesce(*[F.when(F.col("doc_id") % 6 == i, fill(s[0])) for i, s in enumerate(SHAPES)])
    return N.nested(docs.select("doc_id", source.alias("source")), columns)


@query(f"SELECT p_partkey AS doc_id, {by_shape(s[1] for s in SHAPES)} AS text FROM part")
def b2_b10_b20_r5_r6_r7_r9_r11_nested_html(spark, sf):
    """Blocks in lists, quotes and containers, attached blocks, definition lists, figures and attributes."""
    return N.render_nested(nested(spark, sf, N.columns("html")), "html")


@query(f"SELECT p_partkey AS doc_id, {by_shape(s[2] for s in SHAPES)} AS text FROM part")
def r27_s23_nested_canonical(spark, sf):
    return N.render_nested(nested(spark, sf, N.columns("canonical")), "canonical")


@query(f"""SELECT p_partkey AS doc_id, {by_shape((
    "• {n}\n  • {t}\n    • c\n  • [x] d\n• e", "│ │ {n}\n│\n│ • x\n│\n│   {t}\n│\n│ • z\n\ntail", "{n}\n\n• {t}\n\nend",
    "3. {n}\n4. two\n   <E>[2m1 < 2<E>[0m\n   │ {t}\n\npara\nlazy", "{n}\n{t}\nd\n\n<E>[1mH<E>[0m\n═\n\n│ • <E>[1mI<E>[0m\n│   ═\n\ntail", "{n}\n\na\n  b")).replace("<E>", "' || CHR(27) || '")} AS text FROM part""")
def r26_s22_nested_ansi(spark, sf):
    return N.render_nested(nested(spark, sf, N.columns("ansi")), "ansi")


@query(f"""SELECT p_partkey AS doc_id, {by_shape((
    "- {n}\n  - {t}\n    - c\n  - [x] d\n- e", "{n}\n\n- x\n\n  {t}\n\n- z\n\ntail", "{n}\n\n- {t}\n\nend",
    "3. {n}\n4. two\n   1 < 2\n   {t}\n\npara\nlazy", "{n}\n{t}\nd\n\nH\n\n- I\n\ntail", "{n}\n\na\n  b"))} AS text FROM part""")
def r25_s21_nested_plain(spark, sf):
    return N.render_nested(nested(spark, sf, N.columns("plain")), "plain")


@query(f"""SELECT p_partkey AS doc_id, {by_shape((
    "- {n}\n  - {t}\n    - c\n  - [x] d\n- e", "> > {n}\n>\n> - x\n>\n>   {t}\n>\n> - z\n\ntail", "{n}\n\n- {t}\n\nend",
    "3. {n}\n4. two\n   ```py\n   1 < 2\n   ```\n   > {t}\n\npara\nlazy", "{n}\n{t}\nd\n\n# H\n\n> - # I\n\ntail", "![{n}](b)\n\na\n  b"))} AS text FROM part""")
def r23_s20_nested_markdown(spark, sf):
    return N.render_nested(nested(spark, sf, N.columns("markdown")), "markdown")


#: Blocks by depth (from 1) of each shape, counted by hand.
DEPTHS = ((2, 4, 3, 1), (2, 3, 4), (2, 2, 1, 1), (3, 4, 1), (8, 3, 1), (3,))


@query(f"""SELECT p_partkey AS doc_id, d::INTEGER AS depth, n::BIGINT AS n FROM part
  JOIN (VALUES {", ".join(f"({s}, {d + 1}, {n})" for s, ns in enumerate(DEPTHS) for d, n in enumerate(ns))}) v(s, d, n) ON p_partkey % 6 = s""")
def j10_nested_depths(spark, sf):
    """Blocks by depth, hidden ones among them."""
    return nested(spark, sf, ["depth"]).groupBy("doc_id", "depth").agg(F.count("*").alias("n"))

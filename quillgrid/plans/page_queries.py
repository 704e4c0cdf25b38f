"""Queries of whole pages: documents in, resolved HTML out, a few shapes of document for each kind of construct."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators.convert import convert
from quillgrid.operators.frames import nested
from quillgrid.operators.includes import expand
from quillgrid.operators.spans import inline_rows
from quillgrid.plans.base import markup, query, table


def sql_page(text: str) -> str:
    """A literal with {n}, {t}, {s} as the part's name, its type and its name as a heading id."""
    quoted = "'" + text.replace("'", "''").replace("\n", "' || CHR(10) || '") + "'"
    return f"REPLACE(REPLACE(REPLACE({quoted}, '{{n}}', p_name), '{{t}}', p_type), '{{s}}', REPLACE(p_name, ' ', '-'))"


def by_shape(texts) -> str:
    return f"CASE p_partkey % {len(texts)} " + " ".join(f"WHEN {i} THEN {sql_page(t)}" for i, t in enumerate(texts)) + " END"


def sources(spark, sf, shapes):
    docs = markup(spark, sf, "part", "p_partkey", "to_json(struct(p_name n, p_type t))").withColumn("o", F.from_json("source", "n string, t string"))
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{n}"), F.col("o.n")), F.lit("{t}"), F.col("o.t"))
    return docs.select("doc_id", F.coalesce(*[F.when(F.col("doc_id") % len(shapes) == i, fill(s)) for i, (s, _) in enumerate(shapes)]).alias("source"))


def pages(shapes):
    """A query that converts one of the shapes for each part, with the pages in its SQL."""

    def register(f):
        def run(spark, sf):
            return convert(sources(spark, sf, shapes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(f"SELECT p_partkey AS doc_id, {by_shape([h for _, h in shapes])} AS html FROM part")(run)

    return register


SECTIONS = (
    ("# {n}\n\na\n\n## {t}\n\n# {n}\n\nb", '<section id="{s}">\n<h1>{n}</h1>\n<p>a</p>\n<section id="T">\n<h2>{t}</h2>\n</section>\n</section>\n<section id="{s}-2">\n<h1>{n}</h1>\n<p>b</p>\n</section>'),
    ("pre\n\n{#x .c}\n## A *b*\n\n# x\n\n> # {n}\n\n- # {n}", '<p>pre</p>\n<section id="x">\n<h2 class="c">A <strong>b</strong></h2>\n</section>\n<section id="x-2">\n<h1>x</h1>\n<blockquote>\n<h1 id="{s}">{n}</h1>\n</blockquote>\n<ul>\n<li>\n<h1 id="{s}-2">{n}</h1>\n</li>\n</ul>\n</section>'),
    ("### {n}\n\n# {n} %% hidden\n\n#x\n\n# `c` [l](u)", '<section id="{s}">\n<h3>{n}</h3>\n</section>\n<section id="{s}-2">\n<h1>{n}</h1>\n<p><span class="tag"><strong>#x</strong></span></p>\n</section>\n<section id="c-l">\n<h1><code>c</code> <a href="u">l</a></h1>\n</section>'),
)


@pages(tuple((a, b.replace('"T"', '"{T}"')) for a, b in SECTIONS[1:]))
def r1_r3_w1_w3_section_pages(spark, sf):
    """Sections by level, ids given and made, headings in quotes and items."""


@pages((
    ("[{n}][r] and [r][] and [no][x]\n\n[r]: /u \"{t}\"\n[r]: /v", '<p><a href="/v">{n}</a> and <a href="/v">r</a> and [no][x]</p>'),
    ("[a [b] *c*](u) ![i *x*][r]{.k} [a  b][]\n\n[r]: /i {#z}\n[a b]: <//h>", '<p><a href="u">a [b] <strong>c</strong></a> <img src="/i" alt="i *x*" id="z" class="k"> <a href="//h">a  b</a></p>'),
    ("# {n}\n\nsee [{n}][] or [none][]", '<section id="{s}">\n<h1>{n}</h1>\n<p>see <a href="#{s}">{n}</a> or [none][]</p>\n</section>'),
    ("> [t][q]\n\n- ::: box\n  [q]: /deep\n  :::", '<blockquote>\n<p><a href="/deep">t</a></p>\n</blockquote>\n<ul>\n<li>\n<div class="box">\n</div>\n</li>\n</ul>'),
))
def r14_j1_j2_reference_pages(spark, sf):
    """Reference links and images: the last definition holds, headings answer collapsed ones, misses stay source."""


NOTES = '<section role="doc-endnotes" aria-label="Footnotes">\n<hr>\n<ol>\n'
BACK = '<a href="#fnref{}" role="doc-backlink" aria-label="Back to reference">↩</a>'


@pages((
    ("{n}[^a] x[^b] y[^a] z[^none]\n\n[^b]: two\n[^a]: *{t}*\n\n  more", "<p>{n}" + '<a id="fnref1" href="#fn1" role="doc-noteref"><sup>1</sup></a> x<a id="fnref2" href="#fn2" role="doc-noteref"><sup>2</sup></a> y<a id="fnref1-2" href="#fn1" role="doc-noteref"><sup>1</sup></a> z[^none]</p>\n'
     + NOTES + '<li id="fn1">\n<p><strong>{t}</strong></p>\n<p>more<a href="#fnref1" role="doc-backlink" aria-label="Back to reference 1">↩<sup>1</sup></a> <a href="#fnref1-2" role="doc-backlink" aria-label="Back to reference 2">↩<sup>2</sup></a></p>\n</li>\n<li id="fn2">\n<p>two' + BACK.format(2) + "</p>\n</li>\n</ol>\n</section>"),
    ("a^[{n} /e/] [t^[in]](u)\n\n[^unused]: gone", '<p>a<a id="fnref1" href="#fn1" role="doc-noteref"><sup>1</sup></a> <a href="u">t<sup id="fnref2">2</sup></a></p>\n' + NOTES + '<li id="fn1">\n<p>{n} <em>e</em>' + BACK.format(1) + '</p>\n</li>\n<li id="fn2">\n<p>in' + BACK.format(2) + "</p>\n</li>\n</ol>\n</section>"),
    ("- q[^l]\n\n[^l]: see [^m]\n\n  - {n}\n\n[^m]: m", '<ul>\n<li>q<a id="fnref1" href="#fn1" role="doc-noteref"><sup>1</sup></a></li>\n</ul>\n' + NOTES + '<li id="fn1">\n<p>see <a id="fnref2" href="#fn2" role="doc-noteref"><sup>2</sup></a></p>\n<ul>\n<li>{n}</li>\n</ul>\n<p>' + BACK.format(1) + '</p>\n</li>\n<li id="fn2">\n<p>m' + BACK.format(2) + "</p>\n</li>\n</ol>\n</section>"),
))
def r16_a3_j4_note_pages(spark, sf):
    """Notes numbered by first use, repeated, inline, in links and in notes; unused ones are not shown."""


@pages((
    ("HT and {t} and HTX, `HT` *HT*\n\n*[HT]: {n}", '<p><abbr title="{n}">HT</abbr> and {t} and HTX, <code>HT</code> <strong><abbr title="{n}">HT</abbr></strong></p>'),
    ("*[A1]: one & two\n\n- A1\n- B\n\n*[B]: late", '<ul>\n<li><abbr title="one &amp; two">A1</abbr></li>\n<li><abbr title="late">B</abbr></li>\n</ul>'),
    ("{#i}\n# {n} *b*\n\n</#i> </#none>", '<section id="i">\n<h1>{n} <strong>b</strong></h1>\n<p><a href="#i">{n} b</a> &lt;/#none&gt;</p>\n</section>'),
))
def r17_r18_i38_j3_label_pages(spark, sf):
    """Abbreviations wherever they are defined, cross-references with the heading's words."""


@pages((
    ("{*a {,b [c,}] *} d,} e*} \\{+x+} \\{*b*} *m*{#i .c} [x]{.k} {#{n}#}", '<p><strong>a <sub>b [c,}] *} d</sub> e</strong> {+x+} {<strong>b</strong>} <strong id="i" class="c">m</strong> <span class="k">x</span> <span class="critic-comment">{n}</span></p>'),
    ("{~{n}~>*{t}*~} [HT]{kbd} /a *b* c/ **x** a*b*c `*q*` {--} \"q\"", '<p><del>{n}</del><ins><strong>{t}</strong></ins> <kbd>HT</kbd> <em>a <strong>b</strong> c</em> **x** a*b*c <code>*q*</code> – “q”</p>'),
    ("![a\\!b](/i \"t\") <http://x.y/> <m@h.org> $`e`$$`d` `<b>`{=html} @ann #t :x[/y/]", '<p><img src="/i" alt="a!b" title="t"> <a href="http://x.y/">http://x.y/</a> <a href="mailto:m@h.org">m@h.org</a> <span class="math inline" role="math">\\(e\\)</span><span class="math display" role="math">\\[d\\]</span> <b> <span class="mention"><strong>@ann</strong></span> <span class="tag"><strong>#t</strong></span> <span class="ext-x"><em>y</em></span></p>'),
    ("a {% no %}b\\\n{n} %% gone\nc\\ d {=m=}{^2^} ~s~ _u_", '<p>a b<br>\n{n}\nc&nbsp;d <mark>m</mark><sup>2</sup> <s>s</s> <u>u</u></p>'),
))
def i15_i16_i22_i26_i40_r13_inline_pages(spark, sf):
    """Marks in marks, escapes, attributes behind constructs, spans, comments, substitutions."""


@pages((
    ("{n}\n- not a list\n\n- a\n  - b\n+\n> {t}\n\n  para", "<p>{n}\n- not a list</p>\n<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n</ul>\n<blockquote>\n<p>{t}</p>\n</blockquote>\n<p>para</p>\n</li>\n</ul>"),
    ("> - {n}\ntail\n\n> - # H\ntail\n- [x] {t}\n- [ ] b", '<blockquote>\n<ul>\n<li>{n}\ntail</li>\n</ul>\n</blockquote>\n<blockquote>\n<ul>\n<li>\n<h1 id="H">H</h1>\n</li>\n</ul>\n</blockquote>\n<p>tail\n- [x] {t}\n- [ ] b</p>'),
    (":: {n}\n: {t}\n- lazy\n: d\n\n  more\n\n{.k}\n- x\n\n{.q}\n> y\n\n-{.i} z", '<dl>\n<dt>{n}</dt>\n<dd>{t}\n- lazy</dd>\n<dd>\n<p>d</p>\n<p>more</p>\n</dd>\n</dl>\n<ul class="k">\n<li>x</li>\n</ul>\n<blockquote class="q">\n<p>y</p>\n</blockquote>\n<ul>\n<li class="i">z</li>\n</ul>'),
    ("1. ```\n> q\n\n::: note \"{n}\"\n::: in\n- {t}\n:::\n:::\n\n::: |\na\n  *b*\n:::", '<ol>\n<li>\n<pre><code></code></pre>\n</li>\n</ol>\n<blockquote>\n<p>q</p>\n</blockquote>\n<aside class="admonition note" aria-label="{n}">\n<p class="admonition-title">{n}</p>\n<div class="in">\n<ul>\n<li>{t}</li>\n</ul>\n</div>\n</aside>\n<div class="line-block">\n<p>a<br>\n&nbsp;&nbsp;<strong>b</strong></p>\n</div>'),
    ("| *{n}* | b |\n|---|--:|\n| {t} | `x` |\n^ cap *c*\n\n- [x] d\n- e", '<figure>\n<table>\n<thead>\n<tr><th scope="col"><strong>{n}</strong></th><th scope="col" style="text-align: right;">b</th></tr>\n</thead>\n<tbody>\n<tr><td>{t}</td><td style="text-align: right;"><code>x</code></td></tr>\n</tbody>\n</table>\n<figcaption>cap <strong>c</strong></figcaption>\n</figure>\n<ul class="task-list">\n<li data-task-state="x"><input type="checkbox" checked disabled aria-label="d"> d</li>\n</ul>\n<ul>\n<li>e</li>\n</ul>'),
))
def b2_b5_b12_b19_b36_block_pages(spark, sf):
    """What owns a line: lazy lines, items after paragraphs, attached blocks, descriptions, containers, tables, tasks."""


KINDS = (("*{n} /b {=c=}/* [l ^[q]](u)", (("strong", -1), ("text", 0), ("emphasis", 0), ("text", 2), ("highlight", 2), ("text", 4), ("text", -1), ("link", -1), ("text", 7), ("inline_note", 7), ("text", 9))), ("\\*{n}\\* `c`", (("literal", -1), ("text", -1), ("literal", -1), ("text", -1), ("code", -1))))


@query(f"""SELECT p_partkey AS doc_id, o::INTEGER AS ord, k AS kind, q::INTEGER AS parent FROM part
  JOIN (VALUES {", ".join(f"({i}, {o}, '{k}', {q})" for i, (_, rows) in enumerate(KINDS) for o, (k, q) in enumerate(rows))}) v(s, o, k, q) ON p_partkey % {len(KINDS)} = s""")
def i1_inline_rows(spark, sf):
    """Inline constructs of paragraphs with their parents."""
    rows = nested(sources(spark, sf, KINDS)).where("type = 'paragraph'")
    return inline_rows(rows, ["doc_id"]).select("doc_id", "ord", "kind", "parent")


@query("""SELECT n_nationkey::BIGINT AS doc_id, '`{{ f }}` \\{{ f }} {% {{ f }} %} ' || n_name || CHR(10) || '%% {{ f }}' || CHR(10) || '```' || CHR(10) || '{{ f }}' || CHR(10) || '```' || CHR(10)
  || '> ~~~' || CHR(10) || '> {{ f }}' || CHR(10) || '> ~~~' || CHR(10) || 'IN' || CHR(10) || '``a`{{ f }}``' || CHR(10) || '%%%' || CHR(10) || '{{ f }}' AS source FROM nation""")
def j11_literal_contexts(spark, sf):
    """Directives behind a backslash, in code and in comments stay as they are; an open fence holds all that follows."""
    source = "concat('`{{ f }}` \\\\{{ f }} {% {{ f }} %} ', n_name, '\n%% {{ f }}\n```\n{{ f }}\n```\n> ~~~\n> {{ f }}\n> ~~~\n{{ f }}\n``a`{{ f }}``\n%%%\n{{ f }}')"
    files = table(spark, sf, "region").where("r_regionkey = 0").selectExpr("'f' path", "'IN' content")
    return expand(markup(spark, sf, "nation", "n_nationkey", source), files)


@pages((
    ("[{n}](javascript:x) ![i](data:y) [k][r] [ok](mailto:a@b)\n\n[r]: vscode:z", '<p><a href="">{n}</a> <img src="" alt="i"> <a href="">k</a> <a href="mailto:a@b">ok</a></p>'),
    ('*{n}*{title="ms-word:q" onclick=x data-a=1} [l]( JavaScript:x )\n\n{href="jar:a"}\n> q', '<p><strong title="" data-a="1">{n}</strong> <a href="">l</a></p>\n<blockquote href="">\n<p>q</p>\n</blockquote>'),
))
def p13_p14_p16_safe_pages(spark, sf):
    """Destinations and attributes of unsafe schemes are blank, event handlers are gone."""

"""HTML trees, SVG payloads and includes with siblings, cycles, depth and budgets."""

import pytest

from quillgrid.functions.svg import clean
from quillgrid.operators import includes
from quillgrid.sources.html_tree import to_markup

PAGES = {
    "<ol><li>a<ul><li>b<ol start=3><li>c</ol></ul><li>d</ol>": "1. a\n   - b\n     3. c\n2. d\n",
    "<blockquote><p>a</p><p>b</p><ul><li>x</ul></blockquote>": "> a\n>\n> b\n>\n> - x\n",
    "<p><a href='/q'>l</a> &#8364; *x* a/b snake_case <b>s <i>t</i></b>": "[l](/q) € \\*x* a/b snake_case {*s {/t/}*}\n",
    "<table><caption>C</caption><tr><th>h<th colspan=2>k</tr><tr><td rowspan=2>1<td>2|<td>3<tr><td>4<td>5</table>": "|= h |= k | < |\n| 1 | 2\\| | 3 |\n| ^ | 4 | 5 |\n^ C\n",
    "<h2 id=a class='x y' onclick=z>T <code>a`b</code></h2><pre>x\n```\ny</pre>": "{#a .x .y}\n## T ``a`b``\n\n````\nx\n```\ny\n````\n",
    "<a href=' java\nscript:x'>bad</a> <b>end<br></b>": "bad {*end*}\n",
    "<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>x_1</annotation></semantics></math><p>1. no list<p># none": "$`x_1`\n\n1\\. no list\n\n\\# none\n",
    "<dl><dt>t<dd>d<p>e</dl>": ":: t\n: d\n\n  e\n",
    "": "\n",
    "<div>" * 3000 + "x": "x\n",
}


@pytest.mark.parametrize("page", PAGES)
def test_html_trees(page):
    assert to_markup(page) == PAGES[page]


@pytest.mark.parametrize(
    ("payload", "wanted"),
    [
        ("<svg><g onload=alert(1)></g></svg>", "<svg><g></g></svg>"),
        ("<svg><script>alert(1)</script><path d='M0'/></svg>", '<svg><path d="M0"/></svg>'),
        ("<svg><foreignObject><p>x</p></foreignObject><rect/></svg>", "<svg><rect/></svg>"),
        ('<svg><use href="http://e/x#a"/><use href="#a"/></svg>', '<svg><use/><use href="#a"/></svg>'),
        ('<svg><rect fill="url(http://e)" stroke="url(#s)"/></svg>', '<svg><rect stroke="url(#s)"/></svg>'),
        ('<svg><rect fill="u\\72l(//e)" style="x:y"/></svg>', "<svg><rect/></svg>"),
        ('<svg><a href="java&#115;cript:1">t</a><text>a &lt; b</text></svg>', "<svg><text>a &lt; b</text></svg>"),
        ('<svg viewBox="0 0 1 1"><linearGradient id="g"/>', '<svg viewBox="0 0 1 1"><linearGradient id="g"/></svg>'),
        ("no drawing", ""),
    ],
)
def test_svg_keeps_drawing_alone(payload, wanted):
    assert clean(payload) == wanted


def run(spark, sources, files, **bounds):
    docs, table = spark.createDataFrame(list(sources.items()), "doc_id long, source string"), spark.createDataFrame(list(files.items()), "path string, content string")
    texts = {r.doc_id: r.source for r in includes.expand(docs, table, **bounds).collect()}
    return texts, sorted((r.doc_id, r.rule) for r in includes.refusals(docs, table, **bounds).collect())


def test_siblings_and_repeats_expand_all(spark):
    files = {f"f{i}": f"<{i}>" for i in range(20)} | {"in": "[{{ f1 }}{{ f2 }}]", "none": None, "empty": ""}
    texts, refused = run(spark, {1: " ".join(f"{{{{ f{i} }}}}" for i in range(20)), 2: "{{ f3 }}\n{{ f3 }}", 3: "a {{ in }} {{ in }} b", 4: "plain", 5: None, 6: "{{ gone }}{{ none }}x{{ empty }}"}, files)
    assert texts == {1: " ".join(f"<{i}>" for i in range(20)), 2: "<3>\n<3>", 3: "a [<1><2>] [<1><2>] b", 4: "plain", 5: "", 6: "{{ gone }}{{ none }}x"}
    assert refused == [(6, "include-unresolved")] * 2


def test_cycles_depth_and_budget_are_refused_in_place(spark):
    files = {"a": "A{{ b }}", "b": "B{{ a }}", **{f"d{i}": f"{i}{{{{ d{i + 1} }}}}" for i in range(6)}, "big": "x" * 300}
    texts, refused = run(spark, {1: "{{ a }}-{{ b }}", 2: "{{ d0 }}", 3: "{{ big }}|{{ big }}|{{ big }}"}, files, depth=3, budget=700)
    assert texts == {1: "AB{{ a }}-BA{{ b }}", 2: "012{{ d3 }}", 3: "x" * 300 + "|" + "x" * 300 + "|{{ big }}"}
    assert refused == [(1, "include-cycle"), (1, "include-cycle"), (2, "include-depth"), (3, "include-budget")]


def test_selectors(spark):
    files = {"s": "# One\na\n## Two\nb\n# Three\nc", "t": "k,v,w\n1,2,3\n4,5,6\n7,8,9"}
    texts, _ = run(spark, {1: "{{ s#Two }}", 2: "{{ s#One }}", 3: "{{ t @rows:2-3 }}", 4: "{{ t @cols:w,k }}", 5: "{{ s#Three @shift:2 }}", 6: "{{ s#Nope }}"}, files)
    assert texts == {1: "## Two\nb", 2: "# One\na\n## Two\nb", 3: "k,v,w\n4,5,6\n7,8,9", 4: "w,k\n3,1\n6,4\n9,7", 5: "### Three\nc", 6: files["s"]}

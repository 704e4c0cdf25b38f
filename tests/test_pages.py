"""Inline trees, block ownership and whole pages: rules one by one, edges, and texts made to be slow."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators.convert import convert
from quillgrid.operators.frames import HOLDERS, Blocks, nested
from quillgrid.operators.spans import BARE, BRACED, Inlines, inline_rows


def tree(text):
    """Inline rows as nested lists: text as it stands, constructs as (kind, content...)."""
    rows = Inlines(text).rows

    def under(parent):
        return [r[4] if r[3] in ("text", "literal", "soft_break", "literal_text") else (r[3], *([r[4]] if r[2] is None else under(i))) for i, r in enumerate(rows) if r[0] == parent]

    return under(-1)


@pytest.mark.parametrize("d", BRACED)
def test_braced_marks(d):
    kind = BRACED[d]
    assert tree(f"{{{d}a\\{d}}}") == [f"{{{d}a", d, "}"]
    assert "".join(tree(f"{{{d}a [b{d}}}] c{d}}}")[0][1:]) == f"a [b{d}}}] c"
    assert tree(f"{{{d}a `x{d}}}` c{d}}}") == [(kind, "a ", ("code", f"x{d}}}"), " c")]
    assert tree(f"{{{d}a {{{d}b{d}}} c{d}}}") == [(kind, "a ", (kind, "b"), " c")]
    assert tree(f"{{{d}a [b](x{d}}}) c{d}}}") == [(kind, "a ", ("link", "b"), " c")]
    assert tree(f"{{{d}{d}}}")[0][0] != kind


@pytest.mark.parametrize("d", BARE)
def test_bare_marks(d):
    kind = BARE[d]
    assert tree(f"{d}a{d}") == [(kind, "a")]
    assert tree(f"{d}{d}a{d}{d}") == [f"{d}{d}a{d}{d}"] and tree(f"a{d}b{d}c") == [f"a{d}b{d}c"] and tree(f"{d} a{d}") == [f"{d} a{d}"]
    assert tree(f"{d}a\nb{d}") == [(kind, "a", "\n", "b")]
    assert tree(f"\\{d}a{d}") == [d, f"a{d}"]
    assert tree(f"{d}a `{d}` b{d}") == [(kind, "a ", ("code", d), " b")]


def test_brackets_attributes_and_comments():
    assert "".join(tree("[a [b] c](u)")[0][1:]) == "a [b] c" and tree("[a [b] c](u)")[0][0] == "link"
    rows = Inlines('[t](u(v) "w\\"x"){#i .c}{k=v}').rows
    assert rows[0][3:] == ["link", None, "u(v)", 'w"x', "{#i .c k=v}"]
    assert Inlines("*m*{#i}").rows[0][7] == "{#i}" and Inlines("*m*{not=").rows[0][7] is None
    assert tree("{#n*o*#} x{%y%}z") == [("editorial_comment", "n*o*"), " x", ("comment", "y"), "z"]
    assert tree("{~a~>b~} {~a~}") == [("delete", "a"), ("insert", "b"), " ", ("strike", "a")]
    assert tree("`a") == [("code", "a")] and tree("``a`b``") == [("code", "a`b")] and tree("$`x`$$`y`!`*z*`") == [("math", "x"), ("display_math", "y"), "*z*"]
    assert tree("[a][b] [c][]") == [("reference", "a"), " ", ("reference", "c")] and "".join(tree("[d] e")) == "[d] e"
    assert tree("a %% b\nc %d") == ["a", "\n", "c %d"]
    assert tree("") == [] and tree("*" * 300) == ["*" * 300]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_/~={}[]()`\\\n^,+-#%!<>:@\"'.é", max_size=60))
def test_inline_rows_are_a_tree(text):
    rows = Inlines(text).rows
    for i, (parent, start, stop, kind, *_) in enumerate(rows):
        assert parent < i and (stop is None or stop > start), kind
        if parent >= 0:
            assert rows[parent][1] < start and (stop or start) < rows[parent][2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "- b", "  - c", "> q", "> > r", "```", "~~~", "::: x", ":::", "# H", "| t |", ":: t", ": d", "1. n", "+", "%% c", "%%%", "  in", "   more", "{.k}", "[^n]: x", "[r]: /u", "^ cap", "![i](u)", "\tz", "::: |"]), max_size=14))
def test_blocks_are_a_tree_in_document_order(lines):
    rows = Blocks("\n".join(lines)).result()
    paths = [tuple(r["path"]) for r in rows]
    assert paths == sorted(paths) and len(set(paths)) == len(paths)
    types = {tuple(r["path"]): r["type"] for r in rows}
    for path in paths:
        assert len(path) == 1 or types[path[:-1]] in HOLDERS
    opened = [r for r in rows if r["type"] == "list_item"]
    assert sum(r["first_item"] for r in opened) == sum(r["last_item"] for r in opened)


@pytest.mark.parametrize(
    "text",
    ["[" * 30_000, "{*" * 15_000, "*a " * 15_000, "```a" + "``b" * 10_000, "{~a" * 9_000 + "~>" * 9_000, "[a](" * 15_000, "*a{" * 9_000, "{#x " * 9_000, "{*a " * 5_000 + "*}" * 5_000, "[a" * 9_000 + "](u)" * 9_000, "{*[a" * 5_000 + "]*}" * 5_000, "`" * 9_000],
)
def test_inlines_take_time_in_proportion(text):
    began = time.time()
    Inlines(text)
    assert time.time() - began < 10


@pytest.mark.parametrize("text", ["- " * 9_000 + "x", "> " * 9_000 + "x", "> - a\n" * 9_000, "::: x\n" * 4_000, "%%%\n" * 9_001, "{a\n" * 9_000, "1. a\n   - b\n" * 4_000])
def test_blocks_take_time_in_proportion(text):
    began = time.time()
    Blocks(text).result()
    assert time.time() - began < 10


def test_pages_of_odd_documents(spark):
    deep = "- " * 150 + "x"
    sources = [None, "", " \n\n", "a\r\nb", "[^1]: unused", "x[^1] y^[i]\n\n[^1]: > q", "*[A]: b", "﻿bom", deep, "w " * 200_000, "[a]: u\n[a][a]", "a[^1]\n\n[^1]: b[^1]"]
    docs = spark.createDataFrame([(i, s, 1, "x") for i, s in enumerate(sources)], "doc_id long, source string, place int, html string")
    got = {r.doc_id: r.html for r in convert(docs).collect()}
    assert len(got) == len(sources) and got[0] == got[1] == got[2] == got[4] == got[6] == ""
    assert got[3] == "<p>a\nb</p>" and got[8].count("<li>") == 150 and len(got[9]) > 390_000
    assert "<blockquote>\n<p>q</p>\n</blockquote>" in got[5] and got[5].index("fn1") < got[5].index("fn2")
    assert got[10] == '<p><a href="u">a</a></p>'
    assert got[11].count("doc-backlink") == 2
    assert convert(docs.limit(0)).collect() == []


def test_documents_are_read_apart(spark):
    """Labels, ids and notes of one document never reach another."""
    docs = spark.createDataFrame([(i, f"# H\n\n[l][] x[^n] K\n\n{'[l]: /' + str(i) if i % 2 else ''}\n\n[^n]: note {i}\n\n*[K]: k{i}") for i in range(40)], "doc_id long, source string").repartition(7)
    for r in convert(docs).collect():
        assert (f'href="/{r.doc_id}"' in r.html) == (r.doc_id % 2 == 1) and f"note {r.doc_id}<" in r.html and f'title="k{r.doc_id}"' in r.html and 'id="H"' in r.html and "H-2" not in r.html


def test_whole_texts_keep_their_words(spark):
    """Prose without markup comes back word by word."""
    rng = random.Random(3)
    texts = ["\n\n".join(" ".join(rng.choice(("alpha", "beta,", "gamma.", "(delta)", "é", "42")) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, source string")
    got = {r.doc_id: r.html for r in convert(docs).collect()}
    assert all(got[i] == "\n".join(f"<p>{p}</p>" for p in t.split("\n\n")) for i, t in enumerate(texts))
    rows = nested(docs)
    assert rows.where(F.col("type") != "paragraph").isEmpty()
    assert inline_rows(rows, ["doc_id"]).where("kind <> 'text'").isEmpty()

"""Sections, heading numbers, section closing and item parents against a stack per document."""

import random

from quillgrid.operators import blocks, render, windows


def stacked(levels):
    """parent, next and number of each heading, by position."""
    out = []
    for i, level in enumerate(levels):
        parent = next((j for j in range(i - 1, -1, -1) if levels[j] < level), None)
        following = next((j for j in range(i + 1, len(levels)) if levels[j] <= level), None)
        stack = []
        for x in levels[: i + 1]:
            stack = [s for s in stack if s[0] <= x]
            if stack and stack[-1][0] == x:
                stack[-1][1] += 1
            else:
                stack.append([x, 1])
        out.append((parent, following, ".".join(str(n) for _, n in stack)))
    return out


def test_levels_follow_a_stack(spark):
    rnd = random.Random(5)
    docs = {d: [rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))] for d in range(40)}
    rows = spark.createDataFrame([(d, i, x) for d, levels in docs.items() for i, x in enumerate(levels)], "doc_id long, line_no int, level int")
    cut = {(r.doc_id, r.line_no): (r.parent, r.next) for r in windows.sections(rows).collect()}
    numbers = {(r.doc_id, r.line_no): r.number for r in windows.heading_numbers(rows).collect()}
    for d, levels in docs.items():
        for i, (parent, following, number) in enumerate(stacked(levels)):
            assert cut[d, i] == (parent, following) and numbers[d, i] == number

    sources = spark.createDataFrame([(d, "\n\n".join(f"{'#' * x} h" for x in levels)) for d, levels in docs.items()], "doc_id long, source string")
    for r in render.sections_html(blocks.parse(sources)).collect():
        open_, depth = [], []
        for line in r.text.split("\n"):
            if line.startswith("<section"):
                open_.append(None)
            elif line == "</section>":
                open_.pop()
            elif line.startswith("<h"):
                depth.append(len(open_))
        assert not open_
        levels = docs[r.doc_id]
        wanted, stack = [], []
        for x in levels:
            stack = [s for s in stack if s < x] + [x]
            wanted.append(len(stack))
        assert depth == wanted


def test_item_parents_follow_a_stack(spark):
    rnd = random.Random(6)
    docs = {d: [rnd.randint(0, 9) for _ in range(rnd.randint(1, 40))] for d in range(30)}
    rows = spark.createDataFrame([(d, i, x, "k") for d, indents in docs.items() for i, x in enumerate(indents)], "doc_id long, line_no int, indent int, text string")
    found = {(r.doc_id, r.line_no): r.parent_line for r in blocks.item_parents(rows).collect()}
    for d, indents in docs.items():
        for i, x in enumerate(indents):
            assert found[d, i] == next((j for j in range(i - 1, -1, -1) if indents[j] < x), None)

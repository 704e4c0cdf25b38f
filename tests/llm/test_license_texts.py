"""Licence files that hold a licence's text instead of a statement of it."""

from quillgrid.llm import licenses


def test_full_texts_in_licence_files(spark):
    texts = licenses.full_texts()
    holder = "Copyright (c) 2019 Jo Example and contributors\n\n"
    cases = {
        "bsd3": (holder + texts["BSD-3-Clause"].split("\n", 1)[1], "BSD-3-Clause"),
        "bsd2": (holder + texts["BSD-2-Clause"].split("\n", 1)[1], "BSD-2-Clause"),
        "mit": (holder + texts["MIT"].split("\n\n", 2)[2], "MIT"),
        "isc": (holder + texts["ISC"].split("\n\n", 2)[2], "ISC"),
        "gpl2": (texts["GPL-2.0"], "GPL-2.0"),
        "gpl3": (texts["GPL-3.0"], "GPL-3.0"),
        "lgpl3": (texts["LGPL-3.0"], "LGPL-3.0"),
        "gpl2open": (texts["GPL-2.0"][: len(texts["GPL-2.0"]) // 4], "GPL-2.0"),
    }
    rows = [(2 * i, f"{d}/LICENSE", t) for i, (d, (t, _)) in enumerate(cases.items())] + [(2 * i + 1, f"{d}/src/x.txt", "code") for i, d in enumerate(cases)]
    rows += [(100, "prose/LICENSE", "the cat and the dog of the house went to the river with all of the others in the rain. " * 30), (101, "code/mit.txt", cases["mit"][0]), (102, "none/COPYING", None), (103, "empty/COPYING", "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    for i, (d, (_, name)) in enumerate(cases.items()):
        assert (d, got[2 * i].license, got[2 * i].origin) == (d, name, "text")
        assert (d, got[2 * i + 1].license, got[2 * i + 1].origin, got[2 * i + 1].licence_dir) == (d, name, "inherited", d)
    assert all(got[i].license is None for i in (100, 101, 102, 103))

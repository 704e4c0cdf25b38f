"""Headers as they stand in real files."""

from quillgrid.llm import licenses

GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
HEADERS = (
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    (GNU.format("General Public License", 3), "GPL-3.0"),
    (GNU.format("General Public License", 2), "GPL-2.0"),
    (GNU.format("Lesser General Public License", 3), "LGPL-3.0"),
    (GNU.format("Affero General Public License", 3), "AGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Copyright 2016 The Go Authors. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("Copyright (c) 2020 Foo. All rights reserved.", None),
    ("All rights reserved.", None),
    ("Proprietary and confidential license.", "Proprietary"),
    ("We read the license of the pub before the copyright office opened.", None),
)


def test_headers_as_comments(spark):
    comment = lambda text, lead: "\n".join(f"{lead} {x}".rstrip() for x in text.split("\n")) + "\n\ncode = 1\n"
    texts = [(f"{i}-{n}", comment(text, lead), wanted) for i, (text, wanted) in enumerate(HEADERS) for n, lead in enumerate(("#", "//", " *"))]
    files = spark.createDataFrame([(k, f"{k}/a.py", text) for k, (_, text, _) in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(files).collect()}
    assert {name: got[k] for k, (name, _, _) in enumerate(texts)} == {name: wanted for name, _, wanted in texts}

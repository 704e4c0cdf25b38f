"""License scans, with DataFrame operations alone.

Each sentence or line of a text that mentions a licence is a header; it, all of a text's headers
together, and each block of comment lines that mentions one are compared with licence templates by TF-IDF cosine. The arithmetic stays inside the row:
template weights are a literal of fixed size, so no term is shuffled. The distinct texts of licence files are
also compared whole, with the full texts in ``license_texts``; their terms alone are shuffled. A file without a licence of its own
inherits that of the licence file in its nearest ancestor directory, found by joining the directory's
ancestors to the directories of licence files.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import join_counted, join_small, materialize

#: Licence ids and statements of them; what follows a # tells apart the statements of one licence.
STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "BSD-3-Clause#style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "MPL-2.0#notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC": "Distributed under the ISC License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
    "Proprietary": "Proprietary and confidential license. Unauthorized copying is prohibited.",
}
#: The standard notice of the GNU licences, their names and versions, and the endings of their identifiers.
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU = {"GPL-2.0": ("General Public License", 2), "GPL-3.0": ("General Public License", 3), "LGPL-3.0": ("Lesser General Public License", 3), "AGPL-3.0": ("Affero General Public License", 3)}
TEMPLATES = (
    STATEMENTS
    | {f"{k}#notice": GNU_NOTICE.format(*v) for k, v in GNU.items()}
    | {f"{k}#spdx": f"SPDX-License-Identifier: {k}" for k in STATEMENTS if "#" not in k and k != "Proprietary"}
    | {f"{k}#spdx{end}": f"SPDX-License-Identifier: {k}{end}" for k in GNU for end in ("-only", "-or-later")}
)
#: Base names of licence files.
LICENCE_FILES = ("LICENSE", "LICENSE.txt", "LICENSE.md", "LICENCE", "COPYING", "COPYING.txt", "NOTICE")
CUE = r"(?i)licen[cs]e|copyright|public domain|rights reserved|\bcc (by|0)|\bcc0\b|spdx"
CUT = r"\n|(?<=[.!?])[ \t]+"
#: Consecutive comment lines.
BLOCK = r"(?m)(?:^[ \t]*(?://|#|\*|/\*|;|--)[^\n]*\n?)+"
TERM = r"[^a-z0-9.-]+|[.-]+(?![a-z0-9])|(?<![a-z0-9])[.-]+"


def template_weights(templates: dict[str, str]) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """idf by term, the idf of a term that no template has, and each template's unit vector."""
    terms = {k: [t for t in re.split(TERM, v.lower()) if t] for k, v in templates.items()}
    n = len(terms)
    vocabulary = {t for ts in terms.values() for t in ts}
    idf = {t: math.log((1 + n) / (1 + sum(t in ts for ts in terms.values()))) + 1 for t in sorted(vocabulary)}
    vectors = {}
    for k, ts in terms.items():
        v = {t: ts.count(t) * idf[t] for t in sorted(set(ts))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[k] = {t: x / norm for t, x in v.items()}
    return idf, math.log(1 + n) + 1, vectors


def best_template(terms, templates: dict[str, str]):
    """Struct (similarity, license) of the closest template to an array of terms; null for no terms."""
    idf, rest, vectors = template_weights(templates)
    known = F.from_json(F.lit(json.dumps(idf)), "map<string, double>")
    names = F.map_keys(known)
    literal = F.from_json(F.lit(json.dumps([{"license": k, "v": v} for k, v in vectors.items()])), "array<struct<license: string, v: map<string, double>>>")
    squares = lambda of, weigh: F.aggregate(  # noqa: E731  sum of (count x idf)^2 over runs of sorted terms
        F.array_sort(of),
        F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, t: F.struct(
            t.alias("term"),
            F.when(t == a["term"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            (a["sum"] + F.when(t == a["term"], 2 * a["run"] + 1).otherwise(F.lit(1.0)) * weigh(t)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    norm = F.sqrt(squares(terms, lambda t: F.pow(F.coalesce(F.try_element_at(known, t), F.lit(rest)), F.lit(2.0))))
    inside = F.filter(terms, lambda t: F.array_contains(names, t))
    dot = lambda v: F.aggregate(inside, F.lit(0.0), lambda a, t: a + F.try_element_at(known, t) * F.coalesce(F.try_element_at(v, t), F.lit(0.0)))
    scored = F.transform(literal, lambda x: F.struct((dot(x["v"]) / norm).alias("similarity"), x["license"].alias("license")))
    return F.when(F.size(inside) > 0, F.array_max(scored))


def header_licenses(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.6) -> DataFrame:
    """files (doc_id, path, text, digest) -> doc_id, path, digest, own (license of its headers or null), similarity.

    Ties between templates go to the greater licence id; a template's key is one, with # and a mark if it has several.
    """
    templates = templates or TEMPLATES
    terms_of = lambda s: F.filter(F.split(F.lower(s), TERM), lambda t: t != "")
    headers = F.filter(F.split("text", CUT), lambda s: s.rlike(CUE))
    # The pattern is tried on the whole text first; most texts end there.
    cued = F.col("text").rlike(CUE)
    blocks = F.filter(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0)), lambda s: s.rlike(CUE))
    mentioned = files.select("doc_id", "path", "digest", F.when(cued, headers).alias("headers"), F.when(cued, blocks).alias("blocks"))
    segments = F.concat(F.when(F.size("headers") > 1, F.concat("headers", F.array(F.array_join("headers", " ")))).otherwise(F.col("headers")), "blocks")
    best = F.array_max(F.transform(segments, lambda s: best_template(terms_of(s), templates)))
    found = mentioned.select("doc_id", "path", "digest", best.alias("best"))
    hit = F.col("best.similarity") >= threshold
    return found.select("doc_id", "path", "digest", F.when(hit, F.substring_index("best.license", "#", 1)).alias("own"), F.when(hit, F.col("best.similarity")).alias("similarity"))


@cache
def full_texts() -> dict[str, str]:
    """Licence ids and their full texts; that of AGPL-3.0 is GPL-3.0's under its own name."""
    texts = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    gpl = re.compile(r"GNU(\s+)GENERAL PUBLIC LICENSE", re.IGNORECASE)
    return {**texts, "AGPL-3.0": gpl.sub(lambda m: f"GNU Affero{m[1]}General Public License", texts["GPL-3.0"])}


def text_licenses(texts: DataFrame, threshold: float) -> DataFrame:
    """texts (digest, text) -> digest, text_license, text_similarity of the closest full text, where it reaches the threshold."""
    idf, rest, vectors = template_weights(full_texts())
    names = sorted(vectors)
    rows = json.dumps([{"term": t, "idf": w, "v": [vectors[k].get(t, 0.0) for k in names]} for t, w in idf.items()])
    weights = texts.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<term: string, idf: double, v: array<double>>>")))
    terms = texts.dropDuplicates(["digest"]).select("digest", F.explode(F.split(F.lower("text"), TERM)).alias("term")).where("term <> ''").groupBy("digest", "term").agg(F.count("*").alias("n"))
    square = F.pow(F.col("n") * F.coalesce("idf", F.lit(rest)), F.lit(2.0))
    dots = [F.sum(F.col("n") * F.col("idf") * F.col("v")[i]).alias(f"dot{i}") for i in range(len(names))]
    sums = terms.join(F.broadcast(weights), "term", "left").groupBy("digest").agg(F.sqrt(F.sum(square)).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct((F.coalesce(f"dot{i}", F.lit(0.0)) / F.col("norm")).alias("similarity"), F.lit(k).alias("license")) for i, k in enumerate(names)]))
    return sums.select("digest", best.alias("best")).where(F.col("best.similarity") >= threshold).selectExpr("digest", "best.license text_license", "best.similarity text_similarity")


def scan_licenses(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.6, licence_files: tuple[str, ...] = LICENCE_FILES, text_threshold: float = 0.8) -> DataFrame:
    """One row per row of files (doc_id, path, text): doc_id, path, license, origin, similarity, licence_dir.

    origin: ``text`` if the file is a licence file whose whole text matches a full licence text with a cosine
    of at least text_threshold; else ``header`` if the text's own headers match a template with a cosine of at least threshold;
    ``inherited`` from the nearest ancestor directory (its own included) with a licence file that matches,
    licence_dir names it and similarity is that file's; else ``none`` with nulls. In one directory the most
    similar licence file counts, of equals the greater licence id. A relative path's topmost directory is "". A null or empty text has no headers; a null path has no
    directory; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    digest = F.when(base.isin(*licence_files), F.sha2(F.col("text").cast("binary"), 256))
    texts = files.select(digest.alias("digest"), "text").where("digest is not null")
    whole = materialize(text_licenses(texts, text_threshold), "licence_texts")
    headers = materialize(header_licenses(files.select("doc_id", "path", "text", digest.alias("digest")), templates, threshold), "headers")
    by_text = F.col("text_license").isNotNull()
    own = join_small(headers, whole, ["digest"], "left").select(
        "doc_id",
        "path",
        F.coalesce("text_license", "own").alias("own"),
        F.coalesce("text_similarity", "similarity").alias("similarity"),
        F.when(by_text, "text").when(F.col("own").isNotNull(), "header").alias("by"),
        F.when(F.col("path").rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("dir"),
    )
    licensed = (
        own.where(base.isin(*licence_files) & F.col("own").isNotNull())
        .groupBy(F.col("dir").alias("licence_dir"))
        .agg(F.max(F.struct("similarity", F.col("own").alias("license"))).alias("from_file"))
    )
    # The root is "/" for an absolute path and "" for a relative one.
    parts = F.split(F.when(F.col("dir").isin("/", ""), F.lit("")).otherwise(F.regexp_replace("dir", "^/", "")), "/")
    lead = F.when(F.col("dir").startswith("/"), "/").otherwise("")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.concat(lead, F.array_join(F.slice(parts, 1, i), "/")).alias("licence_dir"), i.alias("depth")))
    dirs = materialize(own.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")), "directories")
    # Every directory asks for its root, so the question is not dealt by directory asked for.
    asked = dirs.select("dir", "n", F.explode(ancestors).alias("a")).select("dir", "n", "a.licence_dir", "a.depth")
    nearest = (
        join_small(asked, materialize(licensed, "licensed"), ["licence_dir"])
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence_dir", "from_file"), "depth").alias("near"), F.first("n").alias("n"))
    )
    placed = join_counted(own.where("dir is not null"), materialize(nearest, "directories"), ["dir"], "left")
    joined = placed.unionByName(own.where("dir is null"), allowMissingColumns=True)
    header, near = F.col("own").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own", "near.from_file.license").alias("license"),
        F.when(header, F.col("by")).when(near, "inherited").otherwise("none").alias("origin"),
        F.coalesce("similarity", "near.from_file.similarity").alias("similarity"),
        F.when(~header, F.col("near.licence_dir")).alias("licence_dir"),
    )


def license_sql(threshold: float = 0.6) -> str:
    """DuckDB SQL for the query's result with the default templates, by joins of exploded terms."""
    idf, rest, vectors = template_weights(TEMPLATES)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    idf_rows = ", ".join(f"({quoted(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    vector_rows = ", ".join(f"({quoted(k)}, {quoted(t)}, {w!r}::DOUBLE)" for k, v in vectors.items() for t, w in v.items())
    names = ", ".join(map(quoted, LICENCE_FILES))
    return f"""
WITH RECURSIVE idf(term, w) AS (VALUES {idf_rows}),
vec(license, term, w) AS (VALUES {vector_rows}),
f AS (
  SELECT doc_id, text, COALESCE(source, 'unknown') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' ||
         CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path
  FROM documents),
lines AS (SELECT doc_id, UNNEST(STRING_SPLIT_REGEX(REGEXP_REPLACE(text, '([.!?])[ \\t]+', '\\1' || CHR(10), 'g'), CHR(10))) AS s FROM f),
heads AS (SELECT doc_id, ROW_NUMBER() OVER () AS seg, s FROM lines WHERE REGEXP_MATCHES(s, '{CUE}')),
blocks AS (SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(text, '{BLOCK}')) AS s FROM f WHERE REGEXP_MATCHES(text, '{CUE}')),
segs AS (
  SELECT doc_id, seg, s FROM heads
  UNION ALL
  SELECT doc_id, 1000000000000 + ROW_NUMBER() OVER (), s FROM blocks WHERE REGEXP_MATCHES(s, '{CUE}')
  UNION ALL
  SELECT doc_id, -1 - doc_id, STRING_AGG(s, ' ' ORDER BY seg) FROM heads GROUP BY doc_id HAVING COUNT(*) > 1),
terms AS (
  SELECT doc_id, seg, UNNEST(LIST_TRANSFORM(STRING_SPLIT_REGEX(LOWER(s), '[^a-z0-9.-]+'), lambda t: REGEXP_REPLACE(REGEXP_REPLACE(t, '[.-]+$', ''), '^[.-]+', ''))) AS term
  FROM segs),
tf AS (SELECT doc_id, seg, term, COUNT(*)::DOUBLE AS n FROM terms WHERE term <> '' GROUP BY ALL),
norm AS (SELECT doc_id, seg, SQRT(SUM(POW(n * COALESCE(w, {rest!r}::DOUBLE), 2))) AS norm FROM tf LEFT JOIN idf USING (term) GROUP BY ALL),
sim AS (
  SELECT tf.doc_id, tf.seg, license, SUM(n * idf.w * vec.w) AS dot
  FROM tf JOIN idf USING (term) JOIN vec USING (term) GROUP BY ALL),
best AS (
  SELECT doc_id, SPLIT_PART(license, '#', 1) AS own, dot / norm AS similarity
  FROM sim JOIN norm USING (doc_id, seg) WHERE dot / norm >= {threshold}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dot / norm DESC, license DESC) = 1),
own AS (SELECT f.doc_id, f.path, own, similarity, REGEXP_EXTRACT(path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN best USING (doc_id)),
lic AS (
  SELECT dir AS licence_dir, own AS license, similarity FROM own
  WHERE REGEXP_EXTRACT(path, '[^/]*$') IN ({names}) AND own IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY dir ORDER BY similarity DESC, own DESC) = 1),
up AS (
  SELECT DISTINCT dir, dir AS a FROM own
  UNION ALL
  SELECT dir, REGEXP_EXTRACT(a, '^(.*)/[^/]*$', 1) FROM up WHERE CONTAINS(a, '/')),
near AS (
  SELECT dir, licence_dir, license, similarity FROM up JOIN lic ON a = licence_dir
  QUALIFY ROW_NUMBER() OVER (PARTITION BY dir ORDER BY LENGTH(a) DESC) = 1)
SELECT own.doc_id, own.path, COALESCE(own.own, near.license) AS license,
       CASE WHEN own.own IS NOT NULL THEN 'header' WHEN near.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       ROUND(COALESCE(own.similarity, near.similarity), 6) AS similarity,
       CASE WHEN own.own IS NULL THEN near.licence_dir END AS licence_dir
FROM own LEFT JOIN near USING (dir)
"""

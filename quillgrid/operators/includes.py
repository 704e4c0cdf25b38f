"""Includes: ``{{ path options }}`` resolved against a table of files by repeated joins, with their warnings.

files has (path, content). A document is rows of pieces in order; each piece knows the files it stands in
(its stack), so that nesting and cycles are told per place, not per document. In a round all open directives
of all documents meet the files in one join. Depth, bytes and calls are bounded as parameters, and every
refusal is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.shared import materialize

DIRECTIVE = r"\{\{ *([^\s}@#]+)?((?:#[^\s}]+)?(?: *@[^\s}]+)*) *\}\}"
#: What holds no directive: escapes, fenced code and comments, code spans, braced and line comments.
LITERAL = r"\\.|(?m:^[ \t>]*(?<fence>`{3,}|~{3,}|%{3,})[^\n]*\n(?s:.*?)(?:^[ \t>]*\k<fence>[`~%]*[ \t]*$|\z))|(?<!`)(?<run>`+)(?!`)(?s:.+?)(?<!`)\k<run>(?!`)|\{%(?s:.*?)%\}|(?m:(?:^|(?<= ))%%[^\n]*)"
#: Options that an include knows.
OPTIONS = ("lines", "region", "shift", "code", "rows", "cols")


def directives(docs: DataFrame, text: str = "source") -> DataFrame:
    """doc_id, ord, path, section, options (array of name:value) of every directive."""
    path = F.regexp_extract_all(F.col(text), F.lit(DIRECTIVE), F.lit(1))
    rest = F.regexp_extract_all(F.col(text), F.lit(DIRECTIVE), F.lit(2))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(path.alias("path"), rest.alias("rest"))).alias("ord", "d"))
    options = F.regexp_extract_all("d.rest", F.lit(r"@([^\s@}]+)"), F.lit(1))
    return rows.select("doc_id", "ord", "d.path", F.regexp_extract("d.rest", r"#([^\s@}]+)", 1).alias("section"), options.alias("options"))


def option(name: str) -> Column:
    """Value of an option, null without it."""
    hit = F.filter("options", lambda o: o.startswith(f"{name}:"))
    return F.regexp_replace(F.get(hit, F.lit(0)), f"^{name}:", "")


def select_part(content: Column, section: Column | None = None) -> Column:
    """Content cut by #section, @lines:N-M or @region:name; a delimited file by @rows:N-M (its first line stays) and @cols:a,b."""
    lines = F.split(content, "\n")
    span = lambda name: (F.regexp_extract(option(name), r"^(\d+)-(\d+)$", 1), F.regexp_extract(option(name), r"^(\d+)-(\d+)$", 2))
    sliced = lambda of, low, high: F.slice(of, low.cast("int"), F.greatest(F.lit(0), high.cast("int") - low.cast("int") + 1))
    low, high = span("lines")
    cut = F.array_join(sliced(lines, low, high), "\n")
    name = option("region")
    begin = F.array_position(F.transform(lines, lambda x: F.trim(x) == F.concat(F.lit("%% region "), name)), F.lit(True))
    end = F.array_position(F.transform(lines, lambda x: F.trim(x) == F.concat(F.lit("%% endregion "), name)), F.lit(True))
    region = F.array_join(F.slice(lines, (begin + 1).cast("int"), F.greatest(F.lit(0), end - begin - 1).cast("int")), "\n")
    chosen = F.when(low != "", cut).when(name.isNotNull() & (begin > 0) & (end > begin), region)
    first, last = span("rows")
    wanted = F.split(option("cols"), ",")
    header = F.split(F.get(lines, F.lit(0)), ",")
    columns = F.filter(F.transform(wanted, lambda w: F.array_position(F.transform(header, F.trim), F.trim(w))), lambda i: i > 0)
    rows = F.when(first != "", F.concat(F.slice(lines, 1, 1), sliced(F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))), first, last))).otherwise(lines)
    picked = F.when(F.size(columns) > 0, F.transform(rows, lambda r: F.array_join(F.transform(columns, lambda i: F.coalesce(F.get(F.split(r, ","), (i - 1).cast("int")), F.lit(""))), ","))).otherwise(rows)
    chosen = chosen.when((first != "") | (F.size(columns) > 0), F.array_join(picked, "\n"))
    if section is not None:
        level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6}) ", 1))
        named = F.transform(lines, lambda x: (level(x) > 0) & (F.regexp_replace(F.regexp_extract(x, r"^#{1,6} +(.*?) *$", 1), r"[^0-9A-Za-z]+", "-") == section))
        at = F.array_position(named, F.lit(True)).cast("int")
        deep = level(F.get(lines, at - 1))
        rest = F.slice(lines, at + 1, F.greatest(F.lit(1), F.size(lines)))
        stop = F.array_position(F.transform(rest, lambda x: (level(x) > 0) & (level(x) <= deep)), F.lit(True)).cast("int")
        chosen = F.when((section != "") & (at > 0), F.array_join(F.slice(lines, at, F.when(stop > 0, stop).otherwise(F.size(lines))), "\n")).otherwise(chosen)
    return F.coalesce(chosen, content)


def shifted(content: Column) -> Column:
    """@shift:N deepens every heading, six at most; @code:lang fences the content."""
    by = F.coalesce(option("shift").cast("int"), F.lit(0))
    deeper = F.array_join(
        F.transform(F.split(content, "\n"), lambda x: F.when(x.rlike("^#{1,6} "), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.length(F.regexp_extract(x, "^(#+)", 1)) + by)), F.regexp_replace(x, "^#+", ""))).otherwise(x)), "\n"
    )
    return F.when(option("code").isNotNull(), F.concat(F.lit("```"), option("code"), F.lit("\n"), content, F.lit("\n```"))).otherwise(deeper)


def pieces(rows: DataFrame) -> DataFrame:
    """rows (doc_id, at, stack, text) cut into runs of text and directives: doc_id, at (one place deeper), stack, text, open.

    A directive behind a backslash, in code or in a comment is text."""
    tokens = rf"{LITERAL}|{DIRECTIVE}"
    between, found = F.split("text", tokens, -1), F.regexp_extract_all("text", F.lit(tokens), F.lit(0))
    cut = F.filter(F.flatten(F.zip_with(between, found, lambda x, y: F.array(x, y))), lambda x: x != "")
    each = rows.select("doc_id", "at", "stack", F.posexplode_outer(cut).alias("i", "text"))
    return each.select("doc_id", F.array_append("at", F.coalesce("i", F.lit(0))).alias("at"), "stack", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(f"^{DIRECTIVE}$"), F.lit(False)).alias("open"))


def expanded(docs: DataFrame, files: DataFrame, depth: int = 16, budget: int = 1 << 20, broadcast_files: int = 10_000) -> DataFrame:
    """The pieces of docs (doc_id, source) after all includes: doc_id, at (place), stack (files around it), text, rule.

    A directive is refused, stays as text and bears a rule when its path is missing (include-unresolved),
    already around it (include-cycle), ``depth`` files deep (include-depth), or would take the document past
    max(budget, 8 x the source's bytes) in the order of its places (include-budget). The same file may
    stand in a document any number of times. Each level of nesting is one round, written to the shared folder.
    """
    found = files.select("path", "content").dropDuplicates(["path"])
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")).first()
    if size.n <= broadcast_files and size.bytes <= 1 << 26:
        found = F.broadcast(found)
    limits = docs.select("doc_id", F.greatest(F.lit(budget), 8 * F.coalesce(F.octet_length("source"), F.lit(0))).alias("budget"))
    start = docs.select("doc_id", F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("stack"), F.coalesce("source", F.lit("")).alias("text"))
    now = materialize(pieces(start).withColumn("rule", F.lit(None).cast("string")), "pieces")
    for level in range(depth + 1):
        open_ = now.where("open")
        if open_.isEmpty():
            break
        rest = F.regexp_extract("text", DIRECTIVE, 2)
        rows = open_.withColumn("path", F.regexp_extract("text", DIRECTIVE, 1)).withColumn("section", F.regexp_extract(rest, r"#([^\s@}]+)", 1)).withColumn("options", F.regexp_extract_all(rest, F.lit(r"@([^\s@}]+)"), F.lit(1)))
        rows = rows.join(found, "path", "left").withColumn("part", shifted(select_part(F.col("content"), F.col("section"))))
        rule = F.when(F.col("content").isNull(), "include-unresolved").when(F.array_contains("stack", F.col("path")), "include-cycle").when(F.lit(level >= depth), "include-depth")
        rows = rows.withColumn("rule", rule)
        used = now.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("used"))
        growth = F.when(F.col("rule").isNull(), F.octet_length("part") - F.octet_length("text")).otherwise(0)
        rows = rows.join(used, "doc_id").join(limits, "doc_id").withColumn("grown", F.sum(growth).over(Window.partitionBy("doc_id").orderBy("at")))
        rows = rows.withColumn("rule", F.coalesce("rule", F.when(F.col("used") + F.col("grown") > F.col("budget"), "include-budget")))
        refused = rows.where("rule is not null").select("doc_id", "at", "stack", "text", F.lit(False).alias("open"), "rule")
        spliced = pieces(rows.where("rule is null").select("doc_id", "at", F.array_append("stack", F.col("path")).alias("stack"), F.col("part").alias("text"))).withColumn("rule", F.lit(None).cast("string"))
        now = materialize(now.where("not open").unionByName(refused).unionByName(spliced), "pieces")
    return now.drop("open")


def expand(docs: DataFrame, files: DataFrame, depth: int = 16, budget: int = 1 << 20) -> DataFrame:
    """docs (doc_id, source) with includes replaced, as told at ``expanded``; doc_id, source."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return expanded(docs, files, depth, budget).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("source"))


def refusals(docs: DataFrame, files: DataFrame, depth: int = 16, budget: int = 1 << 20) -> DataFrame:
    """doc_id, at, stack, directive, rule of every include that ``expanded`` refuses."""
    return expanded(docs, files, depth, budget).where("rule is not null").select("doc_id", "at", "stack", F.col("text").alias("directive"), "rule")


def chains(edges: DataFrame, roots: DataFrame, depth: int = 16) -> DataFrame:
    """Include chains by a recursive query over edges (src, dst) from roots (src): root, dst, depth, cycle."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("include_edges")
    roots.createOrReplaceTempView("include_roots")
    return spark.sql(f"""
        WITH RECURSIVE walk(root, dst, depth, trail, cycle) AS (
          SELECT src, src, 0, array(src), false FROM include_roots
          UNION ALL
          SELECT root, e.dst, depth + 1, array_append(trail, e.dst), array_contains(trail, e.dst)
          FROM walk JOIN include_edges e ON e.src = walk.dst WHERE NOT cycle AND depth < {depth})
        SELECT root, dst, depth, cycle FROM walk WHERE depth > 0""")


def warnings(dirs: DataFrame, files: DataFrame, calls: int = 1000) -> DataFrame:
    """dirs from ``directives`` -> doc_id, ord, rule for everything that can be told from one directive and its file.

    files has (path, content) and may have ``binary``, true where a file is not text.
    """
    plain = files.select("path", "content", *([F.col("binary")] if "binary" in files.columns else [F.lit(False).alias("binary")]))
    rows = dirs.join(plain, "path", "left").withColumn("call", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    names = F.transform("options", lambda o: F.substring_index(o, ":", 1))
    span, n_lines = option("lines"), F.size(F.split("content", "\n"))
    region = option("region")
    marks = lambda word: F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) == F.concat(F.lit(f"%% {word} "), region)))
    deepest = F.array_max(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^(#{1,6}) "), F.lit(1)), F.length))
    picks = F.size(F.array_intersect(names, F.array(F.lit("lines"), F.lit("region")))) + F.when(F.col("section") != "", 1).otherwise(0)
    titles = F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6} +(.*)$"), F.lit(1)), lambda t: F.regexp_replace(t, r"[^0-9A-Za-z]+", "-"))
    hits = F.array(
        F.when(F.col("path") == "", "empty-include-path"),
        F.when((F.col("path") != "") & F.col("content").isNull() & ~F.coalesce("binary", F.lit(False)), "include-unresolved"),
        F.when(F.col("binary"), "include-non-text"),
        F.when((picks > 1) | ((F.col("section") != "") & option("code").isNotNull()), "include-selection-conflict"),
        F.when(region.isNotNull() & F.col("content").isNotNull() & ((marks("region") != 1) | (marks("endregion") != 1)), "include-region-invalid"),
        F.when((F.col("section") != "") & F.col("content").isNotNull() & ~F.array_contains(titles, F.col("section")), "include-section"),
        F.when(deepest + option("shift").try_cast("int") > 6, "include-heading-clamp"),
        F.when(F.size(F.array_except(names, F.array(*map(F.lit, OPTIONS)))) > 0, "include-unknown-option"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "include-duplicate-option"),
        F.when(span.isNotNull() & ~span.rlike(r"^\d+-\d+$"), "include-lines-invalid"),
        F.when(span.rlike(r"^\d+-\d+$") & (F.substring_index(span, "-", 1).try_cast("int") > n_lines), "include-lines-out-of-range"),
        F.when(F.col("call") > calls, "include-call-limit"),
    )
    return rows.select("doc_id", "ord", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def code_in_paragraph(classified: DataFrame) -> DataFrame:
    """Code includes that stand in a line with other text."""
    hit = F.col("line").rlike(r"\{\{[^}]*@code:[^}]*\}\}") & ~F.col("line").rlike(r"^\s*\{\{[^}]*\}\}\s*$")
    return classified.where(hit & (F.col("form") == "text")).select("doc_id", F.col("line_no").alias("line"), F.lit("include-block-in-inline").alias("rule"))

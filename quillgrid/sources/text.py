"""Sources and sinks of markup text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import normalize_source, repair_utf8


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """documents(doc_id, path, source) of whole files under a path or glob; a path without files is an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", repair_utf8("content").alias("source"))


def write_text(rendered: DataFrame, path: str, text: str = "text") -> None:
    """One row per document to Parquet, keyed by doc_id."""
    rendered.select("doc_id", F.col(text).alias("text")).write.mode("errorifexists").parquet(path)


def chunks(rendered: DataFrame, size: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, chunk_no (from 0), chunk: UTF-8 text in pieces of at most ``size`` bytes.

    Pieces are of size // 4 characters, which never take more bytes.
    """
    step = size // 4
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int")))
    rows = rendered.where(F.length(text) > 0).select("doc_id", F.col(text).alias("text"), at.alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * step + 1, F.lit(step)).alias("chunk"))


FRONTMATTER = r"\A---[ ]?([A-Za-z0-9]*)[ \t]*\n((?s:.*?))\n---[ \t]*(?:\n|\z)"


def frontmatter(docs: DataFrame) -> DataFrame:
    """doc_id, format (yaml unless named), content and body: the source after the block; no block, null content."""
    source = normalize_source("source")
    has = source.rlike(FRONTMATTER)
    kind = F.regexp_extract(source, FRONTMATTER, 1)
    return docs.select(
        "doc_id",
        F.when(has, F.when(kind == "", "yaml").otherwise(F.lower(kind))).alias("format"),
        F.when(has, F.regexp_extract(source, FRONTMATTER, 2)).alias("content"),
        F.when(has, F.regexp_replace(source, FRONTMATTER, "")).otherwise(source).alias("body"),
    )


def frontmatter_pairs(front: DataFrame) -> DataFrame:
    """doc_id, key, value: top-level keys of JSON frontmatter, and ``key: value`` lines of the others."""
    json = front.where("format = 'json'").select("doc_id", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))
    line = front.where("format <> 'json'").select("doc_id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(r"^[\w-]+:\s*\S"))
    plain = line.select("doc_id", F.regexp_extract("line", r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[\w-]+:\s*(.*)$", 1)), '^"|"$', "").alias("value"))
    return json.unionByName(plain)


def delimited_records(block_rows: DataFrame) -> DataFrame:
    """Cells of ``csv`` and ``tsv`` fences that carry ``table``: doc_id, start_line, record, field (from 1), value.

    A fence is refused whole when a quote stands inside an unquoted field or text follows a closing quote.
    The final newline adds no record; a quoted field may hold line ends.
    """
    info = F.col("fence.info")
    fences = block_rows.where(F.col("type") == "code").where(info.rlike(r"^(csv|tsv)\b.*\btable\b"))
    tab = info.startswith("tsv")
    text = F.regexp_replace("text", "\n$", "")
    record = r'(?:"(?:[^"]|"")*"|[^"\n])+'

    def well(d: str) -> str:
        field = rf'(?:"(?:[^"]|"")*"|[^"{d}\n]*)'
        return rf"\A{field}(?:[{d}\n]{field})*\z"

    rows = fences.where(F.length(text) > 0).where(F.when(tab, text.rlike(well("\t"))).otherwise(text.rlike(well(",")))).select("doc_id", "start_line", tab.alias("tab"), text.alias("text"))
    rows = rows.select("doc_id", "start_line", "tab", F.posexplode(F.regexp_extract_all("text", F.lit(record), F.lit(0))).alias("record", "line"), "text")

    def fields(d: str):
        raw = F.regexp_extract_all("line", F.lit(rf'(?:"(?:[^"]|"")*"|[^"{d}]+)|(?<={d})(?={d}|$)|^(?={d})'), F.lit(0))
        return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))

    rows = rows.withColumn("fields", F.when(F.col("tab"), fields("\t")).otherwise(fields(",")))
    return rows.select("doc_id", "start_line", (F.col("record") + 1).alias("record"), F.posexplode("fields").alias("pos", "value")).select(
        "doc_id", "start_line", "record", (F.col("pos") + 1).alias("field"), "value"
    )


def line_offsets(line_rows: DataFrame) -> DataFrame:
    """Byte and code point offset at which each line starts."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return line_rows.select(
        "doc_id",
        "line_no",
        F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("char_offset"),
    )


def migrate(files: DataFrame, convert) -> DataFrame:
    """files (path, source) of Markdown -> path with the new ending, text with local links renamed too."""
    text = F.regexp_replace(convert(F.col("source")), r"\]\((?!https?:)([^)\s#]+)\.md(#[^)\s]*)?\)", "]($1.mk$2)")
    return files.select(F.regexp_replace("path", r"\.md$", ".mk").alias("path"), text.alias("text"))


def broken_links(migrated: DataFrame) -> DataFrame:
    """Local destinations that no migrated file has: path, target. An anti-join of links to outputs."""
    target = F.explode(F.regexp_extract_all("text", F.lit(r"\]\((?!https?:)([^)\s#]+)(?:#[^)\s]*)?\)"), F.lit(1)))
    wanted = migrated.select("path", target.alias("target"))
    return wanted.join(migrated.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")

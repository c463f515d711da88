"""Sources: typed CSV, JSON lines, discovery, page texts, HTML, logs, cached texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as T
from lodestone.functions.arrays import sums_before
from lodestone.operators import scans
from lodestone.operators.scans import Segments
from lodestone.session import map_arrow

#: Schemas of the temporal reference tables.
CODES = "code string, code_type string, level int, parent_code string, description string, chapter int"
NOTIFICATIONS = "notif_id string, series string, number int, year int, issued_on date, effective_from date, superseded_by string, title string, source_doc_id string"
RATES = "code string, levy_type string, rate_pct double, rate_specific string, condition_no string, schedule string, sno int, effective_from date, effective_to date"
LISTS = "code string, list_type string, sno int, description string, effective_from date, effective_to date"
EXEMPTIONS = "sno int, code string, description string, std_rate string, igst_rate string, condition_no string, effective_from date, effective_to date"


def csv_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Typed CSV with a header, read by column name: cells trimmed, blank ones null."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select(*[(cell(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes with parents first (by level, then code)."""
    return csv_table(spark, path, CODES).orderBy("level", "code")


def notification_rows(spark: SparkSession, path: str, notif_id: str) -> tuple[str, DataFrame]:
    """Which table a CSV belongs to, by its header, and its rows with the notification's id."""
    header = set(spark.read.option("header", True).csv(path).columns)
    for kind, mark, schema in (("rates", "levy_type", RATES), ("lists", "list_type", LISTS), ("exemptions", "std_rate", EXEMPTIONS)):
        if mark in header:
            return kind, csv_table(spark, path, schema).withColumn("notif_id", F.lit(notif_id))
    raise ValueError(f"{path}: no levy_type, list_type or std_rate column")


def json_lines(spark: SparkSession, path: str, schema: str, drop_bad: bool = True) -> DataFrame:
    """JSON lines of a schema; bad lines are dropped, or kept in ``_bad`` to be counted."""
    if drop_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def json_with_defaults(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """JSON lines of a schema without bad lines; columns that are absent or null in a line get their default."""
    rows = json_lines(spark, path, schema)
    return rows.select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else F.col(f.name) for f in rows.schema])


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or one JSON array, by the first character."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path)


def discovered(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all matching files under a folder, with their path and the file's number in order of paths."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    files = lines.select("path").distinct().withColumn("file_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path")))  # one row a file
    return lines.join(files, "path").select("path", "file_no", "value")


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Rows of several files or tables, each with the name of its part in ``tag``; columns that a part lacks are null."""
    rows = None
    for name, part in parts.items():
        own = part.withColumn("tag", F.lit(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows


def id_list(df: DataFrame, column: str) -> DataFrame:
    """Ids of a text cell, split at commas and line ends."""
    return df.select(F.explode(F.split(column, r"[,\n]")).alias("id")).select(F.trim("id").alias("id")).where("id <> ''").distinct()


def pages_of(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Pages of form-feed separated text with their offsets; an empty last page is dropped."""
    parts = F.split(text, "\f")
    parts = F.when(F.trim(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    # Offsets are sums inside the row's own array, so no text is shuffled.
    sizes = lambda p: sums_before(F.transform(p, lambda x: F.length(x) + 1))
    pages = T.let(parts, lambda p: F.arrays_zip(p.alias("text"), sizes(p).alias("at")))
    rows = df.select(id_column, F.posexplode(pages).alias("page", "p"))
    return rows.select(id_column, (F.col("page") + 1).alias("page"), F.col("p.at").cast("int").alias("char_start"), F.col("p.text").alias("text"))


def marker_offsets(text: Column, marker: str = "--- PAGE ") -> Column:
    """Offsets of pages in a text with marker lines: 0, and where each line begins that starts with the marker."""

    def of(lines: Column) -> Column:
        at = F.zip_with(sums_before(F.transform(lines, lambda x: F.length(x) + 1)), lines, lambda o, x: F.when(x.startswith(marker), o))
        return F.concat(F.array(F.lit(0).cast("long")), F.array_compact(at))

    return T.let(F.split(text, "\n"), of)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files under a folder, by Spark's own listing; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """path and text of the files under a folder, each whole (form-feed separated or with marker lines)."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_sources(docs: DataFrame, paths: list[str], there: DataFrame, cache: DataFrame, least: int = 500) -> DataFrame:
    """Where each document's text comes from: doc_id, path, text, page_offsets, reason.

    ``docs`` has doc_id and columns of paths in order of preference; the first one that
    ``there`` (path) lists counts. Without one, an entry of ``cache`` (doc_id, text) of
    more than ``least`` bytes is the text itself, with its page offsets; else the reason
    is "missing". Listed paths meet the documents in equi-joins, a row a path.
    """
    asked = docs.select("doc_id", F.posexplode(F.array(*paths)).alias("at", "path")).where("path is not null")
    held = asked.join(there.select("path").distinct(), "path", "left_semi")
    first = held.groupBy("doc_id").agg(F.min_by("path", "at").alias("path"))
    kept = cache.where(F.octet_length("text") > least).groupBy("doc_id").agg(F.min("text").alias("_text"))
    rows = docs.select("doc_id").join(first, "doc_id", "left").join(kept, "doc_id", "left")
    text = F.when(F.col("path").isNull(), F.col("_text"))
    return rows.select("doc_id", "path", text.alias("text"), marker_offsets(text).alias("page_offsets"), F.when(F.col("path").isNull() & F.col("_text").isNull(), "missing").alias("reason"))


def table_markdown(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a pipe table with a rule below the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---|")), ""))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, 2**30), line)), "\n")


class _Text(HTMLParser):
    """Visible text of a page, with line ends at block tags; if there are main or article elements, only the text of the first one counts."""

    SKIPPED = {"script", "style", "noscript", "svg", "iframe"}
    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "title", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = self.inside = self.seen = 0
        self.all: list[str] = []
        self.main: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        if tag in ("main", "article"):
            self.inside += 1
            self.seen += self.inside == 1
        if tag in self.BLOCKS:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIPPED and self.skip > 0
        if tag in self.BLOCKS:
            self.handle_data("\n")
        self.inside -= tag in ("main", "article") and self.inside > 0

    def handle_data(self, data):
        if not self.skip:
            self.all.append(data)
            if self.inside and self.seen == 1:
                self.main.append(data)


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = "".join(parser.main if any(p.strip() for p in parser.main) else parser.all)
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


PAGES_AT_ONCE = 64


def html_text(df: DataFrame, id_column: str, html: str) -> DataFrame:
    """id and text of HTML pages, a few pages at a time, so that a task holds few of them as objects."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGES_AT_ONCE):
                piece = batch.slice(at, PAGES_AT_ONCE)
                texts = [page_text(page) for page in piece.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(id_column), pa.array(texts, pa.string())], [id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_arrow(df.select(id_column, html), apply, f"{id_column} {kind}, text string")


def cached_text(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Each document's cached text, by content hash first and by doc_id else; null if none. Both have sha256 and doc_id."""
    by_hash = cache.groupBy("sha256").agg(F.min("text").alias("_by_hash"))
    by_id = cache.groupBy("doc_id").agg(F.min("text").alias("_by_id"))
    return docs.join(by_hash, "sha256", "left").join(by_id, "doc_id", "left").withColumn("text", F.coalesce("_by_hash", "_by_id")).drop("_by_hash", "_by_id")


def page_markers(df: DataFrame, id_column: str, text: str, marker: str = r"--- PAGE \d+") -> DataFrame:
    """Page numbers and their starts from markers in a text."""
    pieces = F.split(text, marker)
    numbers = F.regexp_extract_all(F.col(text), F.lit(r"--- PAGE (\d+)"), 1)
    return df.select(id_column, F.posexplode(F.arrays_zip(numbers.alias("page"), F.slice(pieces, F.lit(2), F.size(numbers)).alias("text"))).alias("at", "p")).select(
        id_column, F.col("p.page").cast("int").alias("page"), "p.text"
    )


def request_log(lines: DataFrame, line_no: str, value: str, server: list[str]) -> DataFrame:
    """Request records from a multi-line log: lines between "task N start" and "task N done" belong to task N of a server."""
    task = F.nullif(F.regexp_extract(value, r"task (\d+)", 1), F.lit("")).cast("long")
    rows = Segments.of(lines, server, [line_no]).add(task=scans.last_known(task)).result().where("task is not null")
    tokens = F.nullif(F.regexp_extract(value, r"tokens[ =](\d+)", 1), F.lit("")).cast("long")
    took = F.nullif(F.regexp_extract(value, r"([\d.]+) ?ms", 1), F.lit("")).cast("double")
    return rows.groupBy(*server, "task").agg(F.min(line_no).alias("first_line"), F.max(tokens).alias("tokens"), F.max(took).alias("ms"), F.max(F.col(value).contains("done").cast("int")).alias("done"))


def download_body(df: DataFrame, body: str) -> DataFrame:
    """Adds ``content`` (base64 in a JSON ``data`` field unwrapped) and ``is_pdf``."""
    wrapped = F.get_json_object(body, "$.data")
    content = F.coalesce(F.unbase64(wrapped), F.col(body).cast("binary"))
    return df.withColumn("content", content).withColumn("is_pdf", F.substring(F.col("content").cast("string"), 1, 4) == "%PDF")


def gold_items(spark: SparkSession, text: str) -> DataFrame:
    """Gold items of a YAML text (driver side, a small file): the list itself, or under items, questions or gold."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML") from missing
    data = yaml.safe_load(text)
    if isinstance(data, dict):
        data = next((data[k] for k in ("items", "questions", "gold", "queries") if k in data), [])
    rows = [(str(i.get("id")), i.get("category"), i.get("question") or i.get("query"), [str(x) for x in i.get("expected_sections") or []]) for i in data]
    return spark.createDataFrame(rows, "id string, category string, question string, expected_sections array<string>")

"""Document sources: section records (path, ord, text, page, slide, section) of files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

RECORD = "path string, ord int, text string, page int, slide int, section string"
SUFFIXES = {".pdf", ".pptx", ".docx", ".md", ".markdown", ".txt", ".html", ".htm", ".ipynb", ".json"}


#: Splits whose numbers of lines may be broadcast.
SPLITS = 100_000


def json_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, line_no (from 1; blank lines count, but make no row) and line of files of JSON lines.

    Files are read by splits, many tasks a file. A first pass counts the lines of each split; sums over a file's splits in order tell the number before each, and the second pass
    adds a line's place in its split, which is its distance from the split's first row.
    """
    raw = spark.read.options(**options).text(path, lineSep="\n")
    rows = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("row").alias("first"))
    ahead = F.sum("lines").over(Window.partitionBy("path").orderBy("block")) - F.col("lines")
    starts = splits.select("path", "block", (ahead - F.col("first") + 1).alias("offset"))
    near = F.broadcast(starts) if starts.limit(SPLITS + 1).count() <= SPLITS else starts
    line = F.regexp_replace("value", "\r$", "")
    return rows.join(near, ["path", "block"]).select("path", (F.col("offset") + F.col("row")).alias("line_no"), line.alias("line")).where(T.strip(F.col("line")) != "")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line_no and the parsed row of files of JSON lines; malformed JSON fails."""
    return json_lines(spark, path).select("path", "line_no", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("row"))


def files(spark: SparkSession, root: str, suffixes: set[str] = SUFFIXES, excluded: set[str] = frozenset()) -> DataFrame:
    """path, suffix and content of files below ``root``, without those in excluded folders (any case)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    folders = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.lower)
    kept = found.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes))
    return kept.where(~F.arrays_overlap(folders, F.array(*[F.lit(x.lower()) for x in excluded]).cast("array<string>"))).select("path", "suffix", "content")


def sections(lines: DataFrame, keys: list[str], line_no: str, line: str, is_heading: Column, heading: Column) -> DataFrame:
    """Lines gathered into sections: keys, ord, section and text; a heading opens one and isn't part of it, and an unnamed one keeps the name before."""
    own = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"_h": is_heading, "_name": F.when(is_heading, F.nullif(heading, F.lit("")))})
    rows = rows.withColumn("ord", F.sum(F.col("_h").cast("int")).over(own)).withColumn("section", F.last("_name", ignorenulls=True).over(own))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, line))), lambda x: x[line]), "\n")
    return rows.where(~F.col("_h")).groupBy(*keys, "ord", "section").agg(T.strip(body).alias("text")).where("text <> ''")


def markdown(docs: DataFrame) -> DataFrame:
    """path and section records of Markdown texts (path, text); texts of only headings become one record."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    stripped = F.regexp_replace("line", r"(?U)^\s+", "")
    found = sections(lines, ["path"], "i", "line", stripped.startswith("#"), T.strip(F.regexp_replace(stripped, "^#+", "")))
    whole = docs.join(found.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("section"), T.strip(F.col("text")).alias("text")).where("text <> ''")
    return found.unionByName(whole)


def notebook(docs: DataFrame) -> DataFrame:
    """path and section records of notebooks (path, text): Markdown cells that start with # open a section."""
    cells = F.from_json("text", "cells array<struct<cell_type:string, source:string>>")["cells"]
    rows = docs.select("path", F.posexplode(cells).alias("i", "cell"))
    lines = F.from_json("cell.source", "array<string>")
    source = T.strip(F.coalesce(F.array_join(lines, ""), F.col("cell.source"), F.lit("")))
    rows = rows.withColumn("source", source).where("source <> ''")
    opens = (F.col("cell.cell_type") == "markdown") & F.col("source").startswith("#")
    first = F.regexp_extract("source", r"^([^\n]*)", 1)
    said = F.when(opens, T.strip(F.regexp_replace("source", r"^[^\n]*\n?", ""))).when(F.col("cell.cell_type") == "code", F.concat(F.lit("Code example:\n"), "source")).otherwise(F.concat(F.lit("Notebook note:\n"), "source"))
    own = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_h": opens, "_name": F.when(opens, F.nullif(T.strip(F.regexp_replace(first, "^#+", "")), F.lit(""))), "said": said})
    rows = rows.withColumn("ord", F.sum(F.col("_h").cast("int")).over(own)).withColumn("section", F.last("_name", ignorenulls=True).over(own)).where("said <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), "\n\n")
    return rows.groupBy("path", "ord", "section").agg(body.alias("text"))


def json_records(text: str, size: int = 25) -> list[tuple[str | None, str]]:
    """(section, text) of a JSON document, pretty-printed: ``size`` items of a list, one field of an object, or another value whole."""
    told, said = json.loads(text), lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    if isinstance(told, list):
        return [(f"items {i + 1}-{min(i + size, len(told))}", said(told[i : i + size])) for i in range(0, len(told), size)]
    return [(str(k), said(v)) for k, v in told.items()] if isinstance(told, dict) else [(None, said(told))]


def json_groups(docs: DataFrame, size: int = 25) -> DataFrame:
    """path, ord, section and text of JSON documents (path, text); malformed JSON fails."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, s, t) for p, text in zip(frame["path"], frame["text"]) for i, (s, t) in enumerate(json_records(text, size))]
            yield pd.DataFrame(rows, columns=["path", "ord", "section", "text"])

    return docs.select("path", "text").mapInPandas(parse, "path string, ord int, section string, text string")


# Elements without an end.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())


class _Sections(HTMLParser):
    """Headings h1 to h4 open sections; p, li, pre and code are its parts, nested ones also on their own. An element without an end tag ends with the one around it."""

    def __init__(self):
        super().__init__()
        self.skipped, self.open, self.parts, self.text, self.heading = 0, [], [], [], None

    def handle_starttag(self, tag, attrs):
        entry = [tag, []] if tag in ("h1", "h2", "h3", "h4", "p", "li", "pre", "code") and not self.skipped else None
        if entry:
            self.parts.append(entry)
        if tag not in VOID:
            self.skipped += tag in ("script", "style", "noscript")
            self.open.append((tag, entry))

    def handle_endtag(self, tag):
        at = max((i for i, (name, _) in enumerate(self.open) if name == tag), default=len(self.open))
        self.skipped -= sum(name in ("script", "style", "noscript") for name, _ in self.open[at:])
        del self.open[at:]

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)
            for _, entry in self.open:
                if entry:
                    entry[1].append(data)


def html_records(html: str) -> list[tuple[str | None, str]]:
    """(section, text) of a page; without any part, all of its text."""
    parser = _Sections()
    parser.feed(html)
    join = lambda pieces: " ".join(x.strip() for x in pieces if x.strip())
    out, name, body = [], None, []
    for tag, pieces in parser.parts:
        said = join(pieces)
        if tag[0] == "h":
            if body:
                out.append((name, "\n".join(body)))
            name, body = said or name, []
        elif said:
            body.append(said)
    if body:
        out.append((name, "\n".join(body)))
    return out or ([(None, whole)] if (whole := "\n".join(x.strip() for x in parser.text if x.strip())) else [])


def html(docs: DataFrame, key: str) -> DataFrame:
    """key, ord, section and text of pages (key, html)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, s, t) for k, page in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for i, (s, t) in enumerate(html_records(page or ""))]
            yield pd.DataFrame(rows, columns=[key, "ord", "section", "text"])

    return docs.select(key, "html").mapInPandas(parse, f"{key} {docs.schema[key].dataType.simpleString()}, ord int, section string, text string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_records(content: bytes) -> list[tuple[str | None, str]]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out, name, body, every = [], None, [], []
    for paragraph in root.iter(f"{_W}p"):
        said = "".join(t.text or "" for t in paragraph.iter(f"{_W}t")).strip()
        if not said:
            continue
        every.append(said)
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        if style is not None and (style.get(f"{_W}val") or "").lower().startswith("heading"):
            if body:
                out.append((name, "\n".join(body)))
            name, body = said, []
        else:
            body.append(said)
    if body:
        out.append((name, "\n".join(body)))
    return out or ([(None, "\n".join(every))] if every else [])


def pptx_records(content: bytes) -> list[tuple[int, str]]:
    """(slide number, text) of slides with text."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    numbers = sorted(int(m[1]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for i in numbers:
        root = ElementTree.fromstring(archive.read(f"ppt/slides/slide{i}.xml"))
        said = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in root.iter(f"{_A}p")]
        if text := "\n".join(x for x in said if x):
            out.append((i, text))
    return out


def pdf_records(content: bytes) -> list[tuple[int, str]]:
    """(page number, text); needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise ValueError("PDF files need pypdf, which isn't installed") from error
    pages = enumerate(PdfReader(io.BytesIO(content)).pages, 1)
    return [(i, text) for i, page in pages if (text := (page.extract_text() or "").strip())]


def binary(found: DataFrame) -> DataFrame:
    """Records of office and PDF files (path, suffix, content)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, suffix, content in zip(frame["path"], frame["suffix"], frame["content"]):
                if suffix == ".docx":
                    rows += [(path, i, t, None, None, s) for i, (s, t) in enumerate(docx_records(content))]
                elif suffix == ".pptx":
                    rows += [(path, i, t, None, n, None) for i, (n, t) in enumerate(pptx_records(content))]
                elif suffix == ".pdf":
                    rows += [(path, i, t, n, None, None) for i, (n, t) in enumerate(pdf_records(content))]
                else:
                    raise ValueError(f"unsupported suffix {suffix}")
            yield pd.DataFrame(rows, columns=["path", "ord", "text", "page", "slide", "section"]).astype({"page": "Int32", "slide": "Int32"})

    return found.select("path", "suffix", "content").mapInPandas(parse, RECORD)


def decoded(found: DataFrame) -> DataFrame:
    """path, suffix and text of text files; bad bytes become U+FFFD."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode("utf-8", "replace"))

    return found.select("path", "suffix", decode("content").alias("text"))


def load(found: DataFrame) -> DataFrame:
    """Records of all supported files (path, suffix, content), by suffix."""
    texts = decoded(found.where(~F.col("suffix").isin(".docx", ".pptx", ".pdf")))
    none = F.lit(None)
    shaped = lambda d: d.select("path", F.col("ord").cast("int"), "text", none.cast("int").alias("page"), none.cast("int").alias("slide"), "section")
    plain = texts.where("suffix = '.txt'").select("path", F.lit(0).alias("ord"), T.strip(F.col("text")).alias("text"), none.cast("string").alias("section")).where("text <> ''")
    page = texts.where(F.col("suffix").isin(".html", ".htm")).select("path", F.col("text").alias("html"))
    parts = [plain, markdown(texts.where(F.col("suffix").isin(".md", ".markdown"))), notebook(texts.where("suffix = '.ipynb'")), json_groups(texts.where("suffix = '.json'")), html(page, "path")]
    out = binary(found.where(F.col("suffix").isin(".docx", ".pptx", ".pdf")))
    for part in parts:
        out = out.unionByName(shaped(part))
    return out


# The two line formats of chat exports.
BRACKET = r"^\[(\d{1,2}[./]\d{1,2}[./]\d{2,4})\s+(\d{1,2}:\d{2})(?::\d{2})?\]\s+(?:([^:]+):\s+)?(.*)$"
DASH = r"^(\d{1,2}[./]\d{1,2}[./]\d{2,4}),?\s+(\d{1,2}:\d{2})(?:\s?[AP]M)?\s+-\s+(?:([^:]+):\s+)?(.*)$"


def chat(exports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index, date, time, author and text of the messages of chat exports (keys, text).

    Lines without a head continue the message above; leading ones make a message without author; empty messages go.
    """
    rows = exports.select(*keys, F.posexplode(F.split("text", r"\R")).alias("i", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    pattern = F.when(F.col("line").rlike(BRACKET), "b").when(F.col("line").rlike(DASH), "d")
    part = lambda n: F.when(F.col("form") == "b", F.regexp_extract("line", BRACKET, n)).when(F.col("form") == "d", F.regexp_extract("line", DASH, n)).otherwise("")
    rows = rows.withColumn("form", pattern)
    rows = rows.select(*keys, "i", "form", part(1).alias("date"), part(2).alias("time"), T.redact(part(3)).alias("author"), T.redact(F.when(F.col("form").isNotNull(), part(4)).otherwise(F.col("line"))).alias("said"))
    own = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("message", F.sum(F.col("form").isNotNull().cast("int")).over(own))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), " ")
    first = lambda c: F.min_by(c, "i").alias(c)
    found = rows.groupBy(*keys, "message").agg(first("date"), first("time"), first("author"), T.strip(said).alias("text")).where("text <> ''")
    return found.withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy("message")) - 1).cast("long")).drop("message")

"""Uploaded files to text: type by declaration, name and bytes, one branch for each format.

HTML, Markdown, CSV and plain text are built-in expressions; JSON, DOCX and PDF run in Arrow batches.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.sources import pdf

# Types that are taken, and the type of an extension.
TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "json": "application/json",
    "html": "text/html",
    "htm": "text/html",
    "csv": "text/csv",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MOST_BYTES = 200 * 1024 * 1024
NAME_LENGTH = 240


def extension(name: Column | str) -> Column:
    return F.lower(F.substring_index(F.col(name) if isinstance(name, str) else name, ".", -1))


def mime_of(declared: Column | str, name: Column | str) -> Column:
    """The declared type if it is taken, else the extension's; null if neither is."""
    declared = F.lower(F.trim(F.substring_index(F.coalesce(F.col(declared) if isinstance(declared, str) else declared, F.lit("")), ";", 1)))
    by_name = F.lit(None).cast("string")
    for e, t in TYPES.items():
        by_name = F.when(extension(name) == e, F.lit(t)).otherwise(by_name)
    return F.when(declared.isin(*sorted(set(TYPES.values()))), declared).otherwise(by_name)


def looks_like_pdf(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.contains(F.decode(F.substring(c, 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))


def looks_like_html(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    head = F.lower(F.decode(F.substring(c, 1, 4096), "ISO-8859-1"))
    return head.rlike(r"<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>]|<title[\s>]")


def uploads(files: DataFrame, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files: name, declared, content, folder_id -> accepted rows and rejected ones with a reason.

    Too large, empty and unknown files are rejected; an unknown folder becomes the root.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    rows = files.withColumn("mime", mime_of("declared", "name")).withColumn("size", size.cast("long")).withColumn("name", X.cut(F.col("name"), NAME_LENGTH))
    reason = F.when(size > MOST_BYTES, "too large").when(size == 0, "empty").when(F.col("mime").isNull(), "unknown type")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").drop("reason")
    if folders is not None and "folder_id" in good.columns:
        known = folders.select("folder_id", F.lit(True).alias("known"))
        good = good.join(known, "folder_id", "left").withColumn("folder_id", F.when(F.col("known"), F.col("folder_id"))).drop("known").select(good.columns)
    return good, rows.filter("reason is not null").select("name", "size", "reason")


def json_text(value: object, depth: int = 0) -> str:
    """Nested values as indented 'key: value' lines, elements of lists one a line, keys in their order."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        return "\n".join(f"{'  ' * depth}{k}: {json_text(v, depth + 1)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(json_text(v, depth + 1) for v in value)
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def flatten_json(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        return json_text(json.loads(raw))
    except ValueError:
        return raw


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word document; the bytes' printable text if it cannot be opened."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error):
        runs = re.findall(r"<w:t[^>]*>(.*?)</w:t>", data.decode("latin-1"), re.S)
        return " ".join(" ".join(re.sub(r"<[^>]+>", "", r) for r in runs).split()) or _printable(data)
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))))


def _printable(data: bytes) -> str:
    return re.sub(r"[^\x20-\x7E一-鿿\s]", " ", data.decode("utf-8", "replace"))


# A literal string of a PDF.
_LITERAL = re.compile(rb"\((?:[^()\\]|\\.)*\)", re.S)


# Fixed value: the note on a file that says it has more pages than are found in it.
MISSING = "PDF 共 {} 页，只读到 {} 页"


def pdf_text(data: bytes) -> tuple[str, list[str] | None, str | None, str | None]:
    """Text, pages, a warning and bookmarks as JSON, which a file without text may have too. Where no page has text, string
    literals are salvaged, also from deflated streams."""
    doc = pdf.opened(data)
    pages = ["\n".join(pdf.lines_of(doc, p)) for p in doc.pages()] if doc else []
    marks = pdf.bookmarks_of(doc) if doc else None
    if any(pages):
        total = doc.count()
        return re.sub(r"[ \t]+\n", "\n", "\n\n".join(pages)).strip(), pages, MISSING.format(total, len(pages)) if total > len(pages) else None, marks
    bodies = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            bodies.append(zlib.decompress(m[1]))
        except zlib.error:
            continue
    found = []
    for body in bodies:
        for m in _LITERAL.finditer(body):
            s = re.sub(r"\\(.)", r"\1", m[0][1:-1].decode("latin-1"), flags=re.S)
            if len(s.strip()) > 1:
                found.append(s)
    text = " ".join(" ".join(found).split())
    return text or _printable(data), None, "the file's text was salvaged from its bytes and may be incomplete", marks


def route(files: DataFrame) -> DataFrame:
    """files: name, mime, content -> with kind: pdf, html, pdf-as-html, pdf-as-text, json, docx, text or other."""
    ext, mime = extension("name"), F.lower(F.coalesce("mime", F.lit("")))
    pdf = (ext == "pdf") | (mime == "application/pdf")
    kind = (
        F.when(pdf & looks_like_pdf("content"), "pdf")
        .when(pdf & looks_like_html("content"), "pdf-as-html")
        .when(pdf, "pdf-as-text")
        .when((mime == "text/plain") | ext.isin("txt", "md", "markdown"), "text")
        .when((mime == "application/json") | (ext == "json"), "json")
        .when(F.contains(mime, F.lit("html")) | ext.isin("html", "htm"), "html")
        .when((mime == "text/csv") | (ext == "csv"), "text")
        .when((ext == "docx") | F.contains(mime, F.lit("wordprocessingml")), "docx")
        .otherwise("other")
    )
    return files.withColumn("kind", kind)


WARNINGS = {
    "pdf-as-html": "declared as PDF, read as the HTML that it is",
    "pdf-as-text": "declared as PDF without its header, read as plain text",
    "docx": "text was taken from a Word file",
    "other": "unknown type, read as plain text",
}


def extract(files: DataFrame) -> DataFrame:
    """files: doc_id, name, mime, content -> doc_id, text, pages, warning, bookmarks. JSON, DOCX and PDF run in Python."""
    rows = route(files)
    decoded = F.decode(F.col("content"), "UTF-8")
    plain = rows.filter(~F.col("kind").isin("pdf", "docx", "json"))
    text = F.when(F.col("kind").isin("html", "pdf-as-html"), X.strip_html(decoded)).when(F.col("kind") == "pdf-as-text", X.printable(decoded)).otherwise(decoded)
    warning = F.lit(None).cast("string")
    for k, v in WARNINGS.items():
        warning = F.when(F.col("kind") == k, F.lit(v)).otherwise(warning)
    none = F.lit(None)
    out = plain.select("doc_id", text.alias("text"), none.cast("array<string>").alias("pages"), warning.alias("warning"), none.cast("string").alias("bookmarks"))
    flat = F.pandas_udf(lambda column: column.map(lambda b: flatten_json(bytes(b).decode("utf-8", "replace"))), T.StringType())
    parsed = rows.filter("kind = 'json'").select("doc_id", flat("content").alias("text"), none.cast("array<string>").alias("pages"), none.cast("string").alias("warning"), none.cast("string").alias("bookmarks"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(docx_text(bytes(x)), None, WARNINGS["docx"], None) if kind == "docx" else pdf_text(bytes(x)) for kind, x in zip(f["kind"], f["content"], strict=True)]
            yield pd.DataFrame(made, columns=["text", "pages", "warning", "bookmarks"]).assign(doc_id=f["doc_id"].to_numpy())

    binary = rows.filter(F.col("kind").isin("pdf", "docx")).select("doc_id", "kind", "content").mapInPandas(read, "text string, pages array<string>, warning string, bookmarks string, doc_id string")
    return out.unionByName(parsed).unionByName(binary)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path as doc_id, name, declared (null), content, size, uploaded_at."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.sha1("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("string").alias("declared"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at"))


def flatten_bookmarks(rows: DataFrame) -> DataFrame:
    """doc_id, bookmarks (nested JSON: title, page, items) -> doc_id, outline. Untitled nodes are skipped, their children kept."""

    def walk(items: list) -> list[dict]:
        out, stack = [], [(x, 1, []) for x in reversed(items)]
        while stack:
            x, level, path = stack.pop()
            title = " ".join(str(x.get("title") or "").split())
            if title:
                out.append({"level": min(level, 9), "title": title, "page": int(x.get("page") or 0), "path": path or None})
            below = [*path, title] if title else path
            stack += [(y, level + 1, below) for y in reversed(x.get("items") or [])]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "outline": [walk(json.loads(b or "[]") or []) for b in f["bookmarks"]]})

    return rows.select("doc_id", "bookmarks").mapInPandas(run, "doc_id string, outline array<struct<level:int,title:string,page:int,path:array<string>>>")


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The docs, chunks and folders of a one-file JSON store."""
    whole = spark.read.option("multiLine", "true").json(path)
    table = lambda name: whole.select(F.explode(name).alias("x")).select("x.*") if name in whole.columns else spark.createDataFrame([], "id string")
    return table("docs"), table("chunks"), table("folders")


def backfilled(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (id) of a store that may be older than some columns, with what is derived from their chunks (docId or id, summary):
    chunkCount, enhancedChunks, pendingEnhance. A folderId that is not there is null: the document is at the root."""
    owner = F.coalesce(*[F.col(c) for c in ("docId",) if c in chunks.columns], F.substring_index("id", "#", 1))
    has = F.coalesce(F.col("summary"), F.lit("")) != "" if "summary" in chunks.columns else F.lit(False)
    n = chunks.groupBy(owner.alias("id")).agg(F.count("*").alias("chunkCount"), F.count_if(has).alias("enhancedChunks"))
    kept = docs.drop("chunkCount", "enhancedChunks", "pendingEnhance")
    kept = kept if "folderId" in docs.columns else kept.withColumn("folderId", F.lit(None).cast("string"))
    rows = kept.join(n, "id", "left").fillna(0, ["chunkCount", "enhancedChunks"])
    return rows.withColumn("pendingEnhance", F.col("chunkCount") - F.col("enhancedChunks"))

"""Documents from files: text as UTF-8, docx by its XML, pdf where a reader is installed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.scratch import located

#: Most files whose contents a Python worker is handed at once.
FILES = 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The non-empty paragraphs of a docx file's body, a line each; those of tables and text boxes are not the body's own."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    mark = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n"}
    # runs stand in the paragraph itself or in a hyperlink of it
    runs = lambda p: (e for r in p if r.tag in (f"{_WORD}r", f"{_WORD}hyperlink") for e in r.iter() if e.tag in mark)
    paragraphs = ("".join(mark[e.tag](e) for e in runs(p)) for p in (body if body is not None else ()) if p.tag == f"{_WORD}p")
    return "\n".join(p for p in paragraphs if p)


def pdf_text(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading pdf needs the pypdf package") from e
    pages = (page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    return "\n".join(p for p in pages if p)


def extracted(path: str, content: bytes) -> str:
    low = path.lower()
    text = docx_text(content) if low.endswith(".docx") else pdf_text(content) if low.endswith(".pdf") else content.decode("utf-8", errors="ignore")
    return text.strip()


def read_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(source_path, document_id, text) of the files at ``path``, a row each.

    A file without extractable text fails the read (``strict``) or is left out. A missing path fails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extracted(p, bytes(c)) for p, c in zip(b["path"], b["content"])]
            if strict and "" in text:
                raise ValueError(f"{b['path'].iloc[text.index('')]} holds no text")
            yield pd.DataFrame({"source_path": b["path"], "text": text})[[bool(t) for t in text]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # a batch holds the files' whole contents
    if int(spark.conf.get(_BATCH)) > FILES:
        spark.conf.set(_BATCH, str(FILES))
    rows = files.mapInPandas(run, "source_path string, text string")
    plain = F.regexp_replace("source_path", "^file:(//)?", "")
    return rows.select(plain.alias("source_path"), document_id(plain).alias("document_id"), "text")


def document_id(path):
    """The first 16 hex digits of the SHA-256 of a resolved path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def accepted_uploads(files: DataFrame, column: str = "path") -> DataFrame:
    """Uploads of the kinds that are taken in: docx and pdf."""
    return files.where(F.col(column).rlike(r"(?i)\.(docx|pdf)$"))


def saved_upload(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    """Writes an upload's bytes into the folder under its own name, over an older one; the path."""
    if not re.fullmatch(r"(?i)[^/\\]+\.(docx|pdf)", name) or name.startswith(".."):
        raise ValueError("uploads are docx or pdf files with a bare name")
    fs, path = located(spark, f"{folder.rstrip('/')}/{name}")
    out = fs.create(path, True)
    out.write(bytearray(content))
    out.close()
    return path.toString()


def sidecar_name(source_path):
    """<stem>.redacted.txt; ``document`` stands in for a path without a name."""
    name = F.regexp_extract(source_path, r"([^/]*)/*$", 1)
    name = F.when(name == "", "document").otherwise(name)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".redacted.txt"))


def write_sidecars(redacted: DataFrame, folder: str) -> None:
    """One folder of text for each document, named as its sidecar; a document told again replaces its own."""
    rows = redacted.select(sidecar_name(F.col("source_path")).alias("name"), F.col("text").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(folder)


def read_sidecar(spark: SparkSession, folder: str, basename: str) -> DataFrame:
    """The text of a sidecar by its bare name, which must end in .txt and hold no path."""
    if not re.fullmatch(r"[^/\\]+\.txt", basename) or basename.startswith(".."):
        raise ValueError("a sidecar is named by its bare name, which ends in .txt")
    return spark.read.text(f"{folder}/name={basename}", wholetext=True)

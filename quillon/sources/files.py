"""Documents from files: text, HTML, Markdown and PDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

TYPES = ("pdf", "md", "html", "txt")


def markdown_to_text(c: Column) -> Column:
    """Text of Markdown by rules: marks of headings, emphasis, code, quotes, lists, links and images go; tables
    stay as they are written. An underscore inside a word is no mark."""
    for pattern, by in ((r"(?m)^#{1,6}\s+", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s{0,3}(?:[-*+]|\d+\.)\s+", ""), (r"`{1,3}", ""), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\w)__(.+?)__(?!\w)", "$1"), (r"\*(\S(?:.*?\S)?)\*", "$1"), (r"(?<!\w)_(\S(?:.*?\S)?)_(?!\w)", "$1")):
        c = T.replace(c, pattern, by)
    return T.html_to_text(c)


def pdf_pages(content: bytes) -> str:
    """Text of a PDF's pages, by whichever of two libraries is installed."""
    import io

    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return "\n".join(p.get_text() for p in doc)
    except ImportError:
        from PyPDF2 import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def read_files(spark: SparkSession, path: str, preserve_newlines: bool = False, pdf: Callable[[bytes], str] = pdf_pages, normalize: bool = True) -> DataFrame:
    """(doc_id, content, source_path, doc_type, error) of all files under a path (folder, file or pattern; any store that
    Spark reads). doc_id is the file's stem and 8 digits of its digest. A file that can't be read has no content but an
    error, and does no harm to the others: a type that isn't known, or a PDF that its library refuses. Bytes that are no
    UTF-8 become the replacement character. With preserve_newlines, white space is levelled line by line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("doc_type", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", ""))

    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for x in b:
                try:
                    found.append((pdf(bytes(x)), None))
                except Exception as e:  # whatever a library makes of a broken file is that file's error
                    found.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["text", "error"])

    from_pdf = F.pandas_udf(text_of, "text string, error string")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    is_known = F.col("doc_type").isin(*TYPES)
    text = F.when(F.col("doc_type") == "html", T.html_to_text(raw)).when(F.col("doc_type") == "md", markdown_to_text(raw)).when(F.col("doc_type") == "txt", raw)
    plain = files.where("doc_type <> 'pdf'").withColumn("text", text).withColumn("error", F.when(~is_known, F.concat(F.lit("unsupported type: "), "doc_type")))
    pdfs = files.where("doc_type = 'pdf'").withColumn("read", from_pdf("content")).select(*files.columns, "read.text", "read.error")
    text = F.col("text")
    if normalize:
        lines = F.array_join(F.transform(F.split("text", "\n"), T.normalize_text), "\n")
        text = T.strip(lines) if preserve_newlines else T.normalize_text(text)
    return plain.unionByName(pdfs).select(F.concat_ws("_", "stem", F.substring(F.md5("content"), 1, 8)).alias("doc_id"), text.alias("content"), F.col("path").alias("source_path"), "doc_type", "error")


def read_documents(spark: SparkSession, path: str, **how) -> DataFrame:
    """(doc_id, content, source_path, doc_type) of the files under a path that can be read; see ``read_files``."""
    return read_files(spark, path, **how).where("error IS NULL").drop("error")


def failed(spark: SparkSession, path: str, **how) -> DataFrame:
    """(source_path, doc_type, error) of files that ``read_documents`` leaves out."""
    return read_files(spark, path, **how).where("error IS NOT NULL").select("source_path", "doc_type", "error")


def unsupported(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, doc_type) of files of unknown types; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    kind = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.([^.]+)$", 1))
    return files.select(F.col("path").alias("source_path"), kind.alias("doc_type")).where(~kind.isin(*TYPES))

"""Files to Markdown: text as it is, PDF by a converter that is a parameter."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.files import first_text_line, good_title, needs_ocr
from ..ship import ship

#: A converter takes a file's bytes and gives its pages' texts and the title in its metadata.
Converter = Callable[[bytes], tuple[list[str], str | None]]


def installed() -> Converter | None:
    """The converter of a library that is there, or None."""
    if importlib.util.find_spec("fitz") is None:
        return None

    def read(content: bytes) -> tuple[list[str], str | None]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [page.get_text("text") for page in doc], (doc.metadata or {}).get("title")

    return read


def pdf_pages(rows: DataFrame, converter: Converter | None = None) -> DataFrame:
    """(path, pages array<string>, meta_title, error) of PDF files (path, content); a file that cannot be read has an error and no pages."""
    converter = converter or installed()
    if converter is None:
        return rows.select("path", F.lit(None).cast("array<string>").alias("pages"), F.lit(None).cast("string").alias("meta_title"), F.lit("no PDF converter is installed").alias("error"))
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append((*converter(content or b""), None))
                except Exception as e:  # one bad file does not end the batch
                    out.append((None, None, str(e) or type(e).__name__))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["path", "pages", "meta_title", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, pages array<string>, meta_title string, error string")


def to_markdown(rows: DataFrame, converter: Converter | None = None) -> DataFrame:
    """(path, text, error, scanned) from files (path, content).

    Text files are decoded, bytes that are no UTF-8 replaced; pages of a PDF follow ``<!-- page: N -->`` marks; any other kind is an error.
    ``scanned`` says that a PDF has so little text that it wants OCR first.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    plain = rows.where(kind.isin("md", "markdown", "txt")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("scanned"))
    marked = F.array_join(F.transform("pages", lambda p, i: F.concat(F.lit("<!-- page: "), (i + 1).cast("string"), F.lit(" -->\n\n"), p)), "\n\n")
    chars = F.aggregate("pages", F.lit(0), lambda n, p: n + F.length(F.trim(p)))
    pdf = pdf_pages(rows.where(kind == "pdf"), converter).select("path", marked.alias("text"), "error", F.coalesce(needs_ocr(chars, F.size("pages")), F.lit(False)).alias("scanned"))
    other = rows.where(~kind.isin("md", "markdown", "txt", "pdf")).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported file type: ."), kind).alias("error"), F.lit(False).alias("scanned"))
    return plain.unionByName(pdf).unionByName(other)


def pdf_fields(rows: DataFrame, converter: Converter | None = None) -> DataFrame:
    """(path, pages, meta_title, first_line) of PDF files, for the catalog; all null where a file cannot be read."""
    got = pdf_pages(rows, converter)
    title = F.trim("meta_title")
    return got.select("path", F.when(F.col("error").isNull(), F.size("pages")).alias("pages"), F.when(good_title(title), title).alias("meta_title"), first_text_line(F.try_element_at("pages", F.lit(1))).alias("first_line"))

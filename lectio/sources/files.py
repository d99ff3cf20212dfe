"""File scans: bytes to raw pages, with failures as rows instead of exceptions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import document_id
from ..operators.clean import paginate, preprocess
from .staging import stage

PDF_SUFFIXES = [".pdf"]
TEXT_SUFFIXES = [".txt", ".md", ".markdown"]
SUPPORTED = PDF_SUFFIXES + TEXT_SUFFIXES


class PdfExtractor(Protocol):
    def pages(self, content: bytes, name: str) -> list[str]: ...


class ExtractionError(ValueError):
    """No extractor could read a file."""


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1))


def dispatch(name: Column) -> Column:
    """pdf, text or unsupported, by the suffix in any case."""
    return F.when(suffix(name).isin(PDF_SUFFIXES), "pdf").when(suffix(name).isin(TEXT_SUFFIXES), "text").otherwise("unsupported")


def read_table(spark: SparkSession, path: str, per_core: int = 16 << 20) -> DataFrame:
    """A Parquet table; a small one, whose few row groups would leave cores idle, is dealt to all of them.

    At most per_core bytes a core move for that; larger tables are read as they lie.
    """
    df = spark.read.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if per_core < size < per_core * cores else df


def scan_files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """name, content of files; a path that doesn't exist fails, as it should."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame(files, "name string, content binary")


class PlumberExtractor:
    """pdfplumber, where it is installed: page texts by layout."""

    def __init__(self, x_tolerance: float = 2.0):
        self.x_tolerance = x_tolerance

    def pages(self, content: bytes, name: str) -> list[str]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [page.extract_text(x_tolerance=self.x_tolerance) or "" for page in pdf.pages]


class PypdfExtractor:
    """pypdf, where it is installed."""

    def pages(self, content: bytes, name: str) -> list[str]:
        import io

        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def default_extractors() -> list[PdfExtractor]:
    """Layout first, the other for files and pages that it can't read. A library that is missing counts as a failure."""
    return [PlumberExtractor(), PypdfExtractor()]


def _damaged(text: str, config: Config) -> bool:
    """words_ran_together() of one page in a worker, to decide whether a second extractor is worth its while."""
    words = re.findall("[A-Za-z]+", text)
    return bool(words) and sum(len(w) > config.runon_word_length for w in words) > config.runon_max_fraction * len(words)


def extract_pdf(files: DataFrame, extractors: list[PdfExtractor], config: Config = DEFAULT) -> DataFrame:
    """doc_id, extractor (its number), page_number, text, message: pages of the first extractor that reads
    a file, and of the next one if one of these pages has words that ran together. The caller merges them with
    repair_pages. An extractor that fails leaves a message."""

    def read(doc: str, name: str, content: bytes) -> list[tuple]:
        rows, done = [], False
        for i, one in enumerate(extractors):
            try:
                texts = one.pages(content, name)
            except Exception as error:  # any failure means: the next extractor
                rows.append((doc, i, None, None, str(error)))
                continue
            rows += [(doc, i, n, text, None) for n, text in enumerate(texts, 1)]
            if done or not any(_damaged(text, config) for text in texts):
                break
            done = True
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for file in zip(*(b.column(c).to_pylist() for c in ("doc_id", "name", "content")), strict=True) for r in read(*file)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t) for c, t in zip(
                        cols, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()], strict=True
                    )
                ],
                ["doc_id", "extractor", "page_number", "text", "message"],
            )

    return files.select("doc_id", "name", "content").mapInArrow(
        run, "doc_id string, extractor int, page_number int, text string, message string"
    )


def load(
    files: DataFrame, extractors: list[PdfExtractor] | None = None, config: Config = DEFAULT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents(doc_id, source_file), clean pages, failures(name, error, message)).

    A file fails alone: an unsupported suffix, a PDF that no extractor reads, or no text at all. The doc_id
    carries the content's hash: files of one name with different contents are different documents, and a file
    given twice is one.
    """
    from ..operators.clean import repair_pages

    named = files.select(
        "name",
        "content",
        dispatch(F.col("name")).alias("kind"),
        document_id(F.col("name"), F.col("content")).alias("doc_id"),
    ).dropDuplicates(["doc_id", "kind"])
    bad = named.where("kind = 'unsupported'").select(
        "name",
        F.lit("UnsupportedDocumentError").alias("error"),
        F.concat(F.lit("supported suffixes: "), F.lit(", ".join(SUPPORTED))).alias("message"),
    )
    text = named.where("kind = 'text'").select("doc_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    raw = paginate(text).withColumn("from_layout", F.lit(False))
    pdf = named.where("kind = 'pdf'")
    if extractors:
        got = stage(extract_pdf(pdf, extractors, config), "pdf-pages")  # a file is read once, whatever follows
        first = got.where("page_number is not null").groupBy("doc_id").agg(F.min("extractor").alias("_first"))
        main = got.join(first, "doc_id").where("extractor = _first and page_number is not null").select("doc_id", "page_number", "text")
        spare = got.join(first, "doc_id").where("extractor > _first and page_number is not null").select("doc_id", "page_number", "text")
        raw = raw.unionByName(repair_pages(main, spare, config).withColumn("from_layout", F.lit(True)))
        unread = got.join(first, "doc_id", "left_anti").where("message is not null").groupBy("doc_id").agg(F.max_by("message", "extractor").alias("message")).select(
            "doc_id", F.lit("ExtractionError").alias("error"), "message"
        )
    else:
        unread = pdf.select("doc_id", F.lit("ExtractionError").alias("error"), F.lit("no PDF extractor is configured").alias("message"))
    pages = stage(preprocess(stage(raw, "raw-pages"), config), "pages")
    names = named.where("kind <> 'unsupported'").select("doc_id", "name", "kind")
    unread = names.where("kind = 'pdf'").join(unread, "doc_id").select("doc_id", "name", "error", "message")
    readable = names.join(unread, "doc_id", "left_anti")
    empty = readable.join(pages, "doc_id", "left_anti").select(
        "name", F.lit("EmptyDocumentError").alias("error"), F.lit("no extractable text").alias("message")
    )
    documents = names.join(pages, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("name").alias("source_file"))
    return documents, pages, bad.unionByName(unread.drop("doc_id")).unionByName(empty)

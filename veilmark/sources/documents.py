"""Documents: text tables, text files, pages of a document, empty texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.text import is_blank, strip


def text_source(spark, path):
    """A parquet table of documents; only the two needed columns are read."""
    return spark.read.parquet(path).select("doc_id", "text")


def suffix(name):
    """Lower-cased extension with its dot; a name that only starts with one has none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def route_by_extension(df, name="path"):
    """Add ``route``: pdf, image, text or unsupported."""
    ext = suffix(F.col(name))
    return df.withColumn(
        "route",
        F.when(ext == ".pdf", "pdf")
        .when(ext.isin(vocab.IMAGE_SUFFIXES), "image")
        .when(ext.isin(vocab.TEXT_SUFFIXES), "text")
        .otherwise("unsupported"),
    )


def decode_text(content):
    """Bytes as UTF-8, bad bytes replaced."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def text_file_source(spark, path, **options):
    """Files as (doc_id, path, text, warnings); other than text files get a warning, no text.

    The id is a hash of the path.  Only the content of text files is read; of the others
    the listing is enough.  Files of length zero give no row: Spark's file sources leave
    them out.
    """

    def files(*columns):
        found = spark.read.format("binaryFile").options(**options).load(path)
        return route_by_extension(found.select(*columns), "path")

    no_warning = F.array().cast("array<string>")
    doc_id = F.xxhash64("path").alias("doc_id")
    texts = files("path", "content").where("route = 'text'").select(
        doc_id, "path", decode_text("content").alias("text"), no_warning.alias("warnings")
    )
    problem = F.concat(
        F.lit("Text extraction warning: "),
        F.when(F.col("route") == "unsupported", "unsupported file type ").otherwise(
            "text of this file type comes from an outside reader: "
        ),
        suffix(F.col("path")),
    )
    others = files("path").where("route <> 'text'").select(
        doc_id, "path", F.lit("").alias("text"), F.array(problem).alias("warnings")
    )
    return texts.unionByName(others)


def join_paragraphs(paragraphs, keys=("doc_id", "page_num")):
    """Paragraphs of a page (columns: keys, para_num, text) joined by line breaks."""
    return (
        paragraphs.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("para_num", "text"))).alias("p"))
        .select(*keys, F.array_join("p.text", "\n").alias("text"))
    )


def page_text(embedded, ocr, page_num):
    """Embedded text if it is longer than 50 characters, else the OCR text with a header."""
    own = strip(embedded)
    return F.expr(
        f"CASE WHEN length({own}) > {vocab.MIN_EMBEDDED_CHARS} THEN {own} "
        f"ELSE concat('[Page ', {page_num}, ']\\n', coalesce({ocr}, '')) END"
    )


def assemble_pages(pages):
    """Document text out of (doc_id, page_num, embedded_text, ocr_text), page_num from 1.

    The pages of one document end up in one text value, so the group is as large
    as its result and no larger.
    """
    return (
        pages.select(
            "doc_id", "page_num", page_text("embedded_text", "ocr_text", "page_num").alias("t")
        )
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("p"))
        .select("doc_id", F.array_join("p.t", "\n\n").alias("text"))
    )


def split_empty(docs):
    """(documents with text, result rows of documents without)."""
    blank = F.expr(is_blank("text"))
    nothing = F.map_from_arrays(F.array(), F.array()).cast("map<string,bigint>")
    empty = docs.filter(blank).select(
        "doc_id",
        F.lit("").alias("original_text"),
        F.lit(0).cast("long").alias("total"),
        nothing.alias("categories"),
        nothing.alias("risks"),
        nothing.alias("sources"),
        F.lit("None").alias("overall_risk"),
        F.lit(vocab.NO_TEXT).alias("explanation"),
        F.lit(vocab.NO_TEXT_HTML).alias("highlighted_html"),
    )
    return docs.filter(~blank), empty

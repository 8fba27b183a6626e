"""Content types, document intake and size limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, web_trim

# Media types.
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
HTML = ("text/html", "application/xhtml+xml")
OCTETS = "application/octet-stream"
# What classify tells apart.
CATEGORIES = ("html", "pdf", "docx", "unsupported")
# First bytes of a PDF.
PDF_MAGIC = b"%PDF-"
MAX_BYTES = 50 * 1024 * 1024


def written_type(content_type: Column) -> Column:
    """Media type without parameters, letter case as written."""
    return web_trim(F.split_part(content_type, F.lit(";"), F.lit(1)))


def mime_essence(content_type: Column) -> Column:
    return F.lower(written_type(content_type))


def classify(content_type: Column) -> Column:
    """html, pdf, docx or unsupported; a missing type counts as html."""
    return let(
        mime_essence(F.coalesce(F.nullif(content_type, F.lit("")), F.lit(HTML[0]))),
        lambda m: F.when(m.isin(*HTML), F.lit("html"))
        .when(m == PDF, F.lit("pdf"))
        .when(m == DOCX, F.lit("docx"))
        .otherwise(F.lit("unsupported")),
    )


def first_bytes(body: Column) -> Column:
    """As much of a body as its kind depends on."""
    return F.substring(body, 1, len(PDF_MAGIC))


def has_pdf_magic(body: Column) -> Column:
    return F.coalesce(first_bytes(body) == F.lit(PDF_MAGIC), F.lit(False))


def refine_by_extension(content_type: Column, extension: Column) -> Column:
    """Octet streams take the type of a known URL extension."""
    known = let(
        extension, lambda e: F.when(e == ".pdf", F.lit(PDF)).when(e == ".docx", F.lit(DOCX))
    )
    return F.when(mime_essence(content_type) == OCTETS, F.coalesce(known, content_type)).otherwise(content_type)


def refine_by_magic(content_type: Column, body: Column) -> Column:
    """Octet streams that start like a PDF are one; others stay as they are."""
    return let(
        content_type, lambda c: F.when((mime_essence(c) == OCTETS) & has_pdf_magic(body), F.lit(PDF)).otherwise(c)
    )


def refined_type(content_type: Column, extension: Column, body: Column) -> Column:
    return refine_by_magic(refine_by_extension(content_type, extension), body)


def unsupported_error(content_type: Column) -> Column:
    return F.concat(F.lit("Unsupported content type: "), F.coalesce(written_type(content_type), F.lit("unknown")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, '' without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def resolve_kind(path: Column, content: Column) -> Column:
    """docx by its name alone; pdf only with PDF bytes; otherwise null."""
    return let(
        file_extension(path),
        lambda e: F.when(e == "docx", F.lit("docx")).when((e == "pdf") & has_pdf_magic(content), F.lit("pdf")),
    )


def intake_status(path: Column, length: Column, cap: int = MAX_BYTES) -> Column:
    """413 for a file over the cap, else 415 for another extension, else null."""
    return F.when(length > cap, F.lit(413)).when(~file_extension(path).isin("pdf", "docx"), F.lit(415))


def intake_error(path: Column, length: Column, cap: int = MAX_BYTES) -> Column:
    megabytes = f"{cap / (1024 * 1024):g}"
    status = intake_status(path, length, cap)
    return F.when(status == 413, F.lit(f"File too large (max {megabytes}MB)")).when(
        status == 415, F.lit("Unsupported file type")
    )


def document_error(category: Column, status: Column, size: Column, cap: int = MAX_BYTES) -> Column:
    """Why a fetched document cannot be used: its status, then its size."""
    label = F.upper(category)
    return F.when(
        ~status.between(200, 299),
        F.concat(F.lit("Failed to process "), label, F.lit(": "), label, F.lit(" fetch failed with status "), status.cast("string")),
    ).when(
        size > cap,
        F.concat(
            F.lit("Failed to process "), label, F.lit(": "), label, F.lit(" too large: "), size.cast("string"),
            F.lit(f" bytes (max {cap})"),
        ),
    )

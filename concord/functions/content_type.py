"""Content type guessed from the leading bytes of a value, as SQL text."""

from __future__ import annotations

# Leading bytes in hex and the file extension they stand for.
PDF_SIGNATURE = "25504446"
ZIP_SIGNATURE = "504B0304"
PDF_EXTENSION = ".pdf"
SPREADSHEET_EXTENSION = ".xlsx"
UNKNOWN_EXTENSION = ".bin"


def leading_bytes(content: str) -> str:
    """The first four bytes in hex; text counts as its UTF-8 bytes."""
    return f"hex(substring(CAST({content} AS BINARY), 1, 4))"


def looks_like_pdf(content: str) -> str:
    """NULL for NULL content."""
    return f"{leading_bytes(content)} = '{PDF_SIGNATURE}'"


def guess_extension(content: str) -> str:
    """NULL for NULL content."""
    return (
        f"CASE WHEN {content} IS NULL THEN NULL "
        f"WHEN {leading_bytes(content)} = '{PDF_SIGNATURE}' THEN '{PDF_EXTENSION}' "
        f"WHEN {leading_bytes(content)} = '{ZIP_SIGNATURE}' THEN '{SPREADSHEET_EXTENSION}' "
        f"ELSE '{UNKNOWN_EXTENSION}' END"
    )

from concord.functions.canonical import canonical_text, content_hash, display_text, plain_text
from concord.functions.content_type import guess_extension, looks_like_pdf
from concord.functions.equality import values_equal

__all__ = [
    "canonical_text",
    "content_hash",
    "display_text",
    "guess_extension",
    "looks_like_pdf",
    "plain_text",
    "values_equal",
]

"""Markup as text with header lines, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a page's markup turns into, in order. Headings become lines
# that chunking recognises, blocks become paragraphs, all other tags go.
MARKUP_RULES: tuple[tuple[str, str], ...] = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<title[^>]*>(.*?)</title>", "\n\n# $1\n\n"),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n"),
    (r"(?is)<h2[^>]*>(.*?)</h2>", "\n\n## $1\n\n"),
    (r"(?is)<h3[^>]*>(.*?)</h3>", "\n\n### $1\n\n"),
    (r"(?is)<h4[^>]*>(.*?)</h4>", "\n\n#### $1\n\n"),
    (r"(?is)<h5[^>]*>(.*?)</h5>", "\n\n##### $1\n\n"),
    (r"(?is)<h6[^>]*>(.*?)</h6>", "\n\n###### $1\n\n"),
    (r"(?i)</?(?:p|div|ul|ol|li|nav|article|section|header|footer|table|tr|br|blockquote|pre)\b[^>]*>", "\n\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\r]*\n[ \t\r\n]*", "\n\n"),
    (r"\A\n+", ""),
    (r"\n+\z", ""),
)


def markdown_of(html: Column) -> Column:
    """The text of a page; its title and headings are header lines."""
    for pattern, replacement in MARKUP_RULES:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(replacement))
    return html

"""HTML page -> article body, as one native regular-expression chain.

Paragraph heuristic of the study: drop comments and script, style, nav,
header, footer and aside blocks; take the first ``article`` element, else the
first ``main``, else the whole page; every ``<p>`` starts a paragraph that
ends at its ``</p>`` or at the next ``<p>`` (unclosed paragraphs are common);
inner tags become spaces, entities are decoded (``&amp;`` last, once),
whitespace is collapsed; paragraphs longer than 40 characters are joined by
newlines. The study's primary extractor is a third-party library with no
Spark counterpart; the paragraph text is the body here, null when empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import WHITESPACE_RUN, bound

REMOVED_BLOCKS = ("script", "style", "nav", "header", "footer", "aside")
# Entities decoded in this order; '&amp;' is last so '&amp;lt;' stays '&lt;'.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))

COMMENT = r"(?s)<!--.*?-->"
PARAGRAPH_START = r"(?i)<p\b[^>]*>"
PARAGRAPH_END = r"(?is)</p\s*>.*$"
ANY_TAG = r"<[^>]*>"


def block_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"


def container_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"


def _decode(x: Column) -> Column:
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def paragraph_text(piece: Column) -> Column:
    x = F.regexp_replace(piece, PARAGRAPH_END, "")
    x = F.regexp_replace(x, ANY_TAG, " ")
    x = _decode(x)
    return F.trim(F.regexp_replace(x, WHITESPACE_RUN, " "))


def extract_body(html, min_paragraph: int = 40) -> Column:
    """Body text of an HTML page (null when no paragraph qualifies).

    Each step's result is bound, so the patterns run over a page once.
    """
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, COMMENT, "")
    for tag in REMOVED_BLOCKS:
        h = F.regexp_replace(h, block_pattern(tag), "")

    def container(h: Column) -> Column:
        return (F.when(h.rlike(r"(?is)<article\b[^>]*>.*?</article\s*>"),
                       F.regexp_extract(h, container_pattern("article"), 1))
                 .when(h.rlike(r"(?is)<main\b[^>]*>.*?</main\s*>"),
                       F.regexp_extract(h, container_pattern("main"), 1))
                 .otherwise(h))

    def paragraphs(pieces: Column) -> Column:
        paras = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), paragraph_text)
        return F.array_join(F.filter(paras, lambda p: F.length(p) > min_paragraph), "\n")

    pieces = F.split(bound(h, container), PARAGRAPH_START)
    return bound(bound(pieces, paragraphs), lambda body: F.when(body != "", body))

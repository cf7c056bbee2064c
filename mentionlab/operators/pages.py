"""Article text out of web pages, by Spark expressions alone.

A page is cut down in steps, each a regular expression that never goes back: comments and raw elements (scripts, styles)
first, then skipped elements from the innermost outwards, then titles; what is left between tags are the body's runs.
"""

from __future__ import annotations

import html
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.session import fresh

#: Elements that go with all they hold, and the least length of a body.
SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript")
LEAST_BODY = 200

#: Stands where something was cut out: text before and after it are two runs.
_CUT = "\x01"
_REST = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>"""  # of a tag, from its name on; quoted values may hold >
_NAMES = "|".join(SKIPPED)
_HIDDEN = rf"(?is)<!--.*?-->|<(script|style)\b{_REST}.*?(?:</\1\b[^>]*+>|\z)"
_INNERMOST = rf"(?i)<(?:{_NAMES})\b{_REST}[^<]*+(?:<(?!/?(?:{_NAMES})\b)[^<]*+)*+</(?:{_NAMES})\b[^>]*+>"
_OPENED = rf"(?i)<(?:{_NAMES})\b{_REST}"
_UNCLOSED = rf"(?is)<(?:{_NAMES})\b{_REST}.*"
_TITLE = rf"(?is)<title\b{_REST}(.*?)(?:</title\b[^>]*+>|\z)"
_TAG = rf"(?s)</?[A-Za-z]{_REST}|<[!?/][^>]*+>"
_REFERENCE = r"&(#?[A-Za-z0-9]+;?)"
#: Names of references that HTML 4 knows, all with a semicolon.
_HTML4 = [f"{n};" for n in name2codepoint]


def _without_skipped(page: Column) -> Column:
    """Skipped elements cut out. An end tag of any of them closes the innermost that is open, one without such is nothing,
    and one that stays open holds the rest of the page; so elements without others inside go first, level by level."""
    shown = F.regexp_replace(page, _HIDDEN, _CUT)
    levels = F.sequence(F.lit(1), F.regexp_count(shown, F.lit(_OPENED)))
    step = lambda x, _: F.when(x.rlike(_INNERMOST), F.regexp_replace(x, _INNERMOST, _CUT)).otherwise(x)
    closed = F.when(shown.rlike(_OPENED), F.aggregate(levels, shown, step)).otherwise(shown)
    return F.regexp_replace(closed, _UNCLOSED, _CUT)


def _known(reference: Column) -> Column:
    """References that the JVM resolves as HTML 5 does: names of HTML 4, and numbers of plain characters."""
    digits = F.regexp_extract(reference, r"^#([0-9]{1,7});$", 1)
    number = F.when(digits != "", digits.cast("long")).otherwise(F.conv(F.regexp_extract(reference, r"^#[xX]([0-9a-fA-F]{1,6});$", 1), 16, 10).cast("long"))
    return reference.isin(_HTML4) | F.coalesce(number.between(32, 126) | number.between(160, 55_295), F.lit(False))


def _html5(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def resolved(text: Column, html5: bool = False) -> Column:
    """Character references resolved. Names of HTML 4 with a semicolon and numbers by the JVM; with html5, texts that hold
    others (further names, no semicolon, numbers of control characters) by Python's rules, only these in Python."""
    plain = F.when(text.contains("&"), F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)).otherwise(text)
    if not html5:
        return plain
    others = F.exists(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), lambda r: ~_known(r))
    return F.when(others, F.pandas_udf(_html5, "string")(F.when(others, text))).otherwise(plain)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s++|(?<!\s)\s++$", "")


def _runs(shown: Column, between: str, html5: bool) -> Column:
    """Runs of text between tags, references resolved, without outer white space and empty ones."""
    parts = F.split(resolved(F.regexp_replace(shown, _TAG, _CUT), html5), _CUT)
    return F.array_join(F.filter(F.transform(parts, _stripped), lambda r: r != ""), between)


def extracted(pages: DataFrame, column: str = "html", names: tuple[str, str] = ("title", "body"), html5: bool = False) -> DataFrame:
    """pages with title and body of a column of HTML: runs of text outside the skipped elements, a title's joined by spaces,
    the body's by line ends, character references resolved (see resolved), those that appear by it once more. Null and empty
    pages have empty ones. A < that begins no tag is text."""
    (shown,) = fresh(pages, "shown")
    page = F.regexp_replace(F.coalesce(column, F.lit("")), _CUT, " ")
    rows = pages.withColumn(shown, _without_skipped(page))
    title = _runs(F.array_join(F.regexp_extract_all(F.col(shown), F.lit(_TITLE), F.lit(1)), _CUT), " ", html5)
    body = _runs(F.regexp_replace(F.col(shown), _TITLE, _CUT), "\n", html5)
    return rows.withColumns({n: _stripped(resolved(x, html5)) for n, x in zip(names, (title, body), strict=True)}).drop(shown)


def substantial(title: Column, body: Column, least: int = LEAST_BODY) -> Column:
    """An extraction that is kept: it has a title and a body of at least `least` characters."""
    return F.coalesce((F.length(title) > 0) & (F.length(body) >= least), F.lit(False))

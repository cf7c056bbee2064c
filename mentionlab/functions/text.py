"""Text, URL and date rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a headline token must not be, besides those of the vocabularies. Place names that a study
#: wants left out are a vocabulary of their own, given to stop_words().
STOP_WORDS = """
a an the and or of in on at to for with from by as is are was were be been being this that
after before over under into out up down off near amid says said say new man woman boy girl
people person police year old years two three four five one his her their its it he she they
""".split()
#: Event terms of the keyword filter.
EVENT_TERMS = (
    "crash", "crashed", "collision", "collided", "smash", "smashed", "head-on", "rollover", "rolled", "flipped", "overturned", "ploughed", "veered", "swerved",
    "hit and run", "car fire", "vehicle fire", "vehicle alight", "car alight", "burst into flames", "engulfed in flames", "went up in flames", "thermal runaway",
    "battery fire", "runaway car", "runaway vehicle", "struck by a car", "hit by a car", "pedestrian struck", "cyclist struck", "mowed down", "mows down",
    "single vehicle", "wrong side of the road", "lost control", "out of control", "off the road", "slammed into", "careered", "careened", "plunged",
    "wrapped around a pole", "wrapped around a tree", "t-boned", "airborne", "launched into", "car hit", "car hits", "vehicle hit", "vehicle hits", "hit by", "bollard",
)
#: Outcome terms of the keyword filter.
OUTCOME_TERMS = (
    "killed", "dies", "died", "dead", "fatal", "fatality", "critical condition", "serious condition", "life-threatening injuries", "trapped", "airlifted",
    "hospitalised", "hospitalized", "taken to hospital", "rushed to hospital", "airlifted to hospital", "written off", "extensively damaged", "extensive damage", "significant damage",
)
#: Query parameters that carry no identity, by the beginning of their lower-cased name.
TRACKING = ("utm_", "fbclid", "gclid", "cmpid", "icid", "ito")
#: Formats of publication times, tried in order.
TIME_FORMATS = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")
#: Patterns of the loss-of-control narrative, any of which is enough, in either case.
NARRATIVE = (
    r"\bploughs? into\b", r"\bplowed into\b", r"\bcrash(?:es|ed)? into\b", r"\bsmash(?:es|ed)? into\b", r"\bcrashed through\b", r"\bploughed through\b",
    r"\bairborne\b", r"\bout of control\b", r"\brunaway\b", r"\blos(?:es|t) control\b", r"\bloss of control\b", r"\brolled\b", r"\brollover\b", r"\bflipped\b",
    r"\bmounts? (?:the )?(?:footpath|kerb|curb)\b", r"\bmounted (?:the )?(?:footpath|kerb|curb)\b",
    r"\binto (?:a |the )?(?:shop|store|building|house|home|restaurant|cafe|bar|pub|wall|fence|pole|bollard|shopfront|shopping centre|shopping center)\b",
)
#: A word character as Python's str patterns have it; Java's \w is ASCII.
WORD = r"[\p{L}\p{N}_]"


def stop_words(*vocabularies: tuple[str, ...]) -> list[str]:
    return sorted({*STOP_WORDS, *(w for v in vocabularies for t in v for w in re.findall("[a-z]+", t.lower()))})


def normalise(text: Column) -> Column:
    """Curly quotes and dashes to ASCII, white space collapsed, lower case, trimmed; null is empty. Compatibility
    decomposition is left to the matcher, where a text is not ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—−", "''\"\"---")
    return F.trim(F.lower(F.regexp_replace(plain, r"\s+", " ")))


def tokenise(text: Column, stop: list[str]) -> Column:
    """Array of tokens `[a-z][a-z'\\-]+|\\d+` of the lower-cased text, longer than two, no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z'\-]+|\d+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def keyword(text: Column, terms: tuple[str, ...]) -> Column:
    """Does any term occur, as a substring, in either case?"""
    return F.coalesce(text.rlike("(?i)" + "|".join(re.escape(t) for t in terms)), F.lit(False))


def _decoded(part: Column) -> Column:
    """A form-encoded string as it was meant; a per cent sign without two hex digits stands for itself."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    """Form encoding; letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Scheme and authority in lower case, the path without slashes at its end, and the kept parameters, encoded anew; no
    fragment. Blank and tracking parameters go."""
    bare = F.regexp_extract(url, "(?s)^([^#]*)", 1)
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    start = F.lower(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_extract(base, "(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), "/+$", "")
    some = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.+"))
    pairs = F.transform(some, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.+)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike("^(" + "|".join(TRACKING) + ")"))
    shown = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(start, path, F.when(shown != "", F.concat(F.lit("?"), shown)).otherwise(""))


def url_hash(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical), 1, 16)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


#: Grammars of slugs by kind: what is taken as the title, and what is cut from its end.
SLUGS = {
    "trailing": (r"(?i)/([a-z0-9][a-z0-9-]{5,})(?:\.html)?/?$", r"(?i)-\d{8}-p[a-z0-9]+$"),
    "dated": (r"/news/\d{4}-\d{2}-\d{2}/([^/]+)/\d+$", None),
    "numbered": (r"(?i)/([a-z0-9][a-z0-9-]{5,})(?:\.html)?/?$", r"(?i)-c-\d+$"),
    "coded": (r"(?i)/article/([^/]+)/[a-z0-9]+/?$", None),
    "story": (r"(?i)/([^/]+)/news-story/[a-f0-9]+/?$", None),
}


def slug_title(url: Column, kind: str) -> Column:
    """Words of a URL's slug; empty where the grammar doesn't match."""
    pattern, cut = SLUGS[kind]
    slug = F.regexp_extract(F.regexp_extract(url, r"^([^?]*)", 1), pattern, 1)
    return F.translate(F.regexp_replace(slug, cut, "") if cut else slug, "-", " ")


def url_date(url: Column) -> Column:
    return F.try_to_date(F.regexp_extract(F.regexp_extract(url, r"^([^?]*)", 1), r"/news/(\d{4}-\d{2}-\d{2})/[^/]+/\d+$", 1), "yyyy-MM-dd")


def publication_date(text: Column) -> Column:
    """Date of a publication time in any of the formats; null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]).cast("date")


def lastmod_date(text: Column) -> Column:
    return F.when(F.length(text) >= 10, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def narrative(text: Column, patterns: tuple[str, ...] = NARRATIVE) -> Column:
    """Does a text match any of the patterns, in either case? Null says no."""
    return F.coalesce(text.rlike("(?iU)" + "|".join(patterns)), F.lit(False))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def sitemap_items(xml: Column) -> Column:
    """Array of (loc, lastmod) of a sitemap; bare locations only where it has no <url> block."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    some = lambda x: F.when(x != "", F.trim(x))
    item = lambda b: F.struct(some(F.regexp_extract(b, r"<loc>([^<]+)</loc>", 1)).alias("loc"), some(F.regexp_extract(b, r"<lastmod>([^<]+)</lastmod>", 1)).alias("lastmod"))
    bare = F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>([^<]+)</loc>"), F.lit(1)), lambda x: F.struct(F.trim(x).alias("loc"), F.lit(None).cast("string").alias("lastmod")))
    return F.when(F.size(blocks) > 0, F.filter(F.transform(blocks, item), lambda x: x["loc"].isNotNull())).otherwise(bare)


def strip_headlines(body: Column, *headlines: Column) -> Column:
    """Body without its headlines (words in order, any non-word characters between) and without a first line in capitals
    of at most twenty words."""
    out = F.coalesce(body, F.lit(""))
    for h in headlines:
        words = F.filter(F.split(F.coalesce(h, F.lit("")), rf"(?U)\W+"), lambda w: w != "")
        loose = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\W*")
        out = F.when(F.size(words) > 0, F.regexp_replace(out, F.concat(F.lit("(?iu)"), loose), F.lit(" "))).otherwise(out)
    first = F.regexp_extract(out, r"^([^\n]*)", 1)
    shout = (F.upper(first) == first) & first.rlike("[A-Z]") & (F.size(F.split(F.trim(first), r"\s+")) <= 20)
    return F.regexp_replace(F.when(shout, F.regexp_replace(out, r"^[^\n]*\n?", "")).otherwise(out), r"^\s+|\s+$", "")


def first_mention(mentions, headline: Column, standfirst: Column, body: Column) -> Column:
    """Where an entity is named first; mentions(text) says whether a text names it. Null without a body."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    yes = lambda x: F.coalesce(mentions(x), F.lit(False))
    return F.when(body.isNull(), None).when(yes(headline), "headline").when(yes(standfirst), "standfirst").when(yes(F.get(lines, F.lit(0))), "first_paragraph").when(yes(body), "later_body").otherwise("absent")


def state_hint(text: Column, hints: dict[str, str], bounded: bool = True) -> Column:
    """The value of the first hint that occurs, as a whole word or (bounded=False) anywhere."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for hint, value in reversed(list(hints.items())):
        hit = low.rlike(rf"(?<!{WORD})\Q{hint}\E(?!{WORD})") if bounded else low.contains(hint)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out

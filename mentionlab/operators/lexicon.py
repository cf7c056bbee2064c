"""Rule-based mention matcher: entities with alias and model tokens, and contexts in which a token is rejected.

A lexicon is a parameter. Tokens match with an optional possessive or plural, any run of spaces and hyphens (or none)
between their words, and not inside a longer word. A match is rejected if one of its token's patterns occurs within
WINDOW characters around it; the first match that is not rejected counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.functions.text import WORD
from mentionlab.operators.covariates import group_of

WINDOW = 40
_FOLD = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-"})


@dataclass(frozen=True)
class Entity:
    name: str
    group: str = ""
    aliases: tuple[str, ...] = ()
    models: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    entities: tuple[Entity, ...]
    rejections: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by lower-cased token
    forbidden: tuple[str, ...] = ()  # tokens that are too ambiguous to be used
    separator: str = "any"  # "any" run of spaces and hyphens, none included; or "single"

    def __post_init__(self) -> None:
        banned = {f.lower() for f in self.forbidden}
        for e in self.entities:
            if bad := [m for m in e.models if m.lower() in banned]:
                raise ValueError(f"ambiguous tokens of {e.name}: {bad}")

    def tokens(self, strict: bool = False) -> list[tuple[str, str]]:
        return [(e.name, t) for e in self.entities for t in (e.aliases if strict else (*e.aliases, *e.models))]

    def pattern(self, token: str, word: str = r"\w") -> str:
        parts = [re.escape(p) for p in re.split(r"[ \-]+", normalise(token)) if p]
        gap = r"[\s\-]*" if self.separator == "any" else r"[\s\-]"
        return rf"(?<!{word}){gap.join(parts)}(?:'s|s'|s)?(?!{word})"

    def groups(self) -> dict[str, str]:
        return {e.name: e.group for e in self.entities}


def normalise(text: str | None) -> str:
    """NFKD, ASCII quotes and dashes, single spaces, lower case, trimmed."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", text or "").translate(_FOLD)).lower().strip()


class Matcher:
    """Patterns compiled once."""

    def __init__(self, lexicon: Lexicon, strict: bool = False):
        self.rows = [(name, token, re.compile(lexicon.pattern(token)), [re.compile(p) for p in lexicon.rejections.get(normalise(token), ())]) for name, token in lexicon.tokens(strict)]

    def mentions(self, text: str | None) -> dict[str, list[str]]:
        t, out = normalise(text), {}
        for name, token, pattern, rejections in self.rows:
            for m in pattern.finditer(t):
                near = t[max(0, m.start() - WINDOW) : m.end() + WINDOW]
                if not any(r.search(near) for r in rejections):
                    out.setdefault(name, []).append(token)
                    break
        return out


def find_mentions(df: DataFrame, text: str, lexicon: Lexicon, strict: bool = False, name: str = "mentions") -> DataFrame:
    """df with a map from entity to its tokens that the text names; the matcher runs over Arrow batches."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` map<string, array<string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon, strict)
        for b in batches:
            found = pa.array([list(m.mentions(t).items()) for t in b.column(text).to_pylist()], pa.map_(pa.string(), pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _pattern(lexicon: Lexicon, token: str) -> str:
    return lexicon.pattern(token, WORD)


def mentions_column(text: Column, lexicon: Lexicon, strict: bool = False) -> Column:
    """Array of named entities as one JVM expression: for lexicons without rejections, over normalised text."""
    if any(normalise(t) in lexicon.rejections for _, t in lexicon.tokens(strict)):
        raise ValueError("a token has rejection contexts: use find_mentions")
    by: dict[str, list[str]] = {}
    for name, token in lexicon.tokens(strict):
        by.setdefault(name, []).append(_pattern(lexicon, token))
    hits = [F.when(text.rlike("|".join(p)), F.lit(name)) for name, p in by.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def canonical(text: Column, lexicon: Lexicon) -> Column:
    """Entity of an alias, by exact match of the normalised string; null if there is none."""
    out = F.lit(None).cast("string")
    for e in reversed(lexicon.entities):
        out = F.when(text.isin([normalise(a) for a in (e.name, *e.aliases)]), F.lit(e.name)).otherwise(out)
    return out


def leaks(vocabularies: tuple[str, ...], lexicon: Lexicon) -> list[tuple[str, str]]:
    """(term, token) for each lexicon token that occurs as a word in a vocabulary term."""
    return [(t, token) for t in vocabularies for _, token in lexicon.tokens() if re.search(lexicon.pattern(token), normalise(t))]


def assert_neutral(vocabularies: tuple[str, ...], lexicon: Lexicon) -> None:
    """Raises ValueError where a search vocabulary names an entity of the lexicon: the search would pick its own outcome."""
    if found := leaks(vocabularies, lexicon):
        raise ValueError(f"vocabulary names entities: {found}")


def with_group(df: DataFrame, entity: str, lexicon: Lexicon, default: str, name: str = "entity_group") -> DataFrame:
    """df with the group of its entity; entities that the lexicon has not, and null, have the default."""
    return df.withColumn(name, group_of(F.col(entity), {e.name: e.group for e in lexicon.entities if e.group}, default))

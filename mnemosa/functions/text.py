"""Words, identities and the small parsers of text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that lexical overlap leaves out.
STOP_WORDS = (
    "the a an of to in on at for and or is are was were be been being it its this that "
    "with as by from into out up down over under how what when where why who which do "
    "does did has have had can could should would will i you we they he she them our your"
).split()
#: Patterns of names in prose: paths, files, snake_case, dotted and CamelCase names.
ENTITIES = (
    r"\b[\w-]+(?:/[\w.-]+)+\b",
    r"\b\w+\.\w{1,5}\b",
    r"\b[a-z]+(?:_[a-z0-9]+)+\b",
    r"(?i)\b[a-z0-9]+\.[a-z0-9]+(?:\.[a-z0-9]+)+\b",
    r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+\b",
)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_id(project: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(project, F.lit("\0"), normalised(text)), 256), 1, 24)


def sensory_id(project: Column, modality: Column, url: Column, text: Column) -> Column:
    z = F.lit("\0")
    return F.substring(F.sha2(F.concat(project, z, modality, z, url, z, normalised(text)), 256), 1, 24)


def chunk_id(project: Column, path: Column, anchor: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", project, path, anchor), 256), 1, 24)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def tokens(text: Column) -> Column:
    """Words of three characters or more that aren't stop words."""
    return F.filter(words(text), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def match_terms(query: Column) -> Column:
    """Terms of a keyword query; repeats stay."""
    return F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), 1)


def normalize_url(url: Column) -> Column:
    return F.lower(F.rtrim(F.split_part(F.split_part(F.trim(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), F.lit("/")))


def _unicode(pattern: str) -> str:
    r"""The pattern with \w and \b of all letters and digits, as Python reads them; in (?i), the letters whose other case is ASCII too."""
    if pattern.startswith("(?i)"):
        pattern = pattern[4:].replace("[a-z0-9]", r"[a-zA-Z0-9\u0130\u0131\u017F\u212A]")
    word = r"[\p{L}\p{N}_]"
    return pattern.replace(r"\w", word).replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def entities(text: Column) -> Column:
    """Names by all five patterns, in small letters, each once; none in null text."""
    text = F.coalesce(text, F.lit(""))
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"({_unicode(p)})"), 1) for p in ENTITIES)))
    return F.array_distinct(F.filter(F.transform(found, lambda e: F.trim(F.lower(e), F.lit("."))), lambda e: F.length(e) >= 4))


def heuristic_facts(text: Column, most: int = 12) -> Column:
    """Lines, or sentences of long lines, of 14 to 240 characters: the first distinct ones."""
    marks = F.lit("-*#• \t")
    line = lambda s: F.trim(s, marks)
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda s: F.when(F.length(line(s)) > 240, F.split(line(s), r"(?<=[.!?])\s+")).otherwise(F.array(line(s)))))
    good = F.filter(F.transform(pieces, F.trim), lambda s: (F.length(s) >= 14) & (F.length(s) <= 240))
    keys = F.transform(good, normalised)
    first = F.filter(F.transform(good, lambda s, i: F.when(F.array_position(keys, F.element_at(keys, i + 1)) == i + 1, s)), lambda s: s.isNotNull())
    return F.slice(first, 1, most)


def clip(text: Column, most: int = 24_000) -> Column:
    """Head of two fifths and tail of three fifths of long texts."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most * 2 // 5), F.lit("\n...\n"), F.substring(text, -(most * 3 // 5), most * 3 // 5)))


def slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))

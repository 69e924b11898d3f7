"""String functions as columns. Character classes are spelled out, so that engines agree on them."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[^\x20\x09-\x0D]+"

# Patterns of reference words and of numbers in text.
REFERENCE_WORD = r"^(?i)(fig(ure)?s?|tab(le)?s?|eqs?|equations?|sec(tion)?s?|refs?|app(endix)?|appendices|chapters?|lines?|l)\.?$"
SECTION_NUMBER = r"^[(\[]?(?:[A-Z]|[0-9]+)(?:\.[0-9]+)*[a-z]?(?:-(?:[A-Z]\.?)?[0-9]+(?:\.[0-9]+)*[a-z]?)?[)\],.;:]*$"
WHOLE_NUMBER = r"^[\[(]?(?:[A-Z]\.)?[0-9]+[a-z]?[\])]?[,.;:]?$"
CITATION = r"^(\[[0-9]+[\],;]?[,.;:]?|[0-9]+\][,.;:]?)$"
EQUATION_NUMBER = r"^\((?:[A-Z]\.)?[0-9]+[a-z]?\)[,.;:]?$"
CITED = r"^\[?[0-9]+(?:-[0-9]*)?(?:,[0-9]+(?:-[0-9]*)?)*[\],]?[,.;:]?$"
JOINING = "^(and|&|-|\u2013|to|,)$"
LISTED = r"^[0-9]+,$"
VERSION_NUMBER = r"[0-9]+(?:[._r][0-9]+)*"
CAPTION = r"^(Figure|Fig\.|Table)[ \t]+((?:[A-Z]\.?)?[0-9]+(?:\.[0-9]+)?)[ \t]*([:.])"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORDS})"), 1)


def digit_skeleton(text: str | Column) -> Column:
    """Every run of digits and dots becomes one `#`."""
    return F.regexp_replace(text, "[0-9.]+", "#")


def round_half_up(x: str | Column) -> Column:
    """Rounds halves toward positive infinity, unlike `round`."""
    return F.floor((F.col(x) if isinstance(x, str) else x) + 0.5)


# Characters that a token's normal form replaces, after compatibility composition.
DASHES = "−‐‑‒–—―"
SINGLE_QUOTES = "‘’‚‛′`´"
DOUBLE_QUOTES = "“”„‟″"
DROPPED = "­            ​  "
_TOKEN_TABLE = str.maketrans({**dict.fromkeys(DASHES, "-"), **dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict.fromkeys(DROPPED, ""), "…": "..."})


def normal_token(token: str) -> str:
    composed = unicodedata.normalize("NFKC", token)
    return composed.translate(_TOKEN_TABLE)


@F.arrow_udf(T.StringType())
def _normal_tokens(tokens: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normal_token(t) for t in tokens.to_pylist()], pa.string())


def normal_form(token: str | Column) -> Column:
    """The form in which tokens are compared, by an Arrow function."""
    return _normal_tokens(token)


def normalize_token(token: str | Column) -> Column:
    """The form in which tokens are compared. Every row goes to Python, ASCII or not: where there are many, filter first,
    as `tokens_of` does, or normalise distinct tokens."""
    token = F.col(token) if isinstance(token, str) else token
    return F.when(token.rlike(r"^[\x00-\x7f]*$"), F.translate(token, "`", "'")).otherwise(_normal_tokens(token))


def suspicious_glyphs(text: str | Column) -> Column:
    """How many characters are for private use or stand for unreadable ones."""
    return F.length(F.regexp_replace(text, "[^\\x{E000}-\\x{F8FF}\\x{FFFD}\\x{F0000}-\\x{10FFFF}]", ""))


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def strip_punctuation(token: str | Column) -> Column:
    return F.regexp_replace(token, r"^[(\[{\"']+|[)\]}\"'.,;:!?]+$", "")


def squash(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def classify_pair(old: Column, new: Column, before1: Column, before2: Column, before3: Column, heading_first: Column, citation: Column) -> Column:
    """How two tokens differ: same, text, numeric or renumber. before1 is the token just before the old one."""
    both = lambda pattern: old.rlike(pattern) & new.rlike(pattern)
    return (
        F.when(old == new, "same")
        .when(~has_digit(old) | ~has_digit(new) | (digit_skeleton(old) != digit_skeleton(new)), "text")
        .when((heading_first | before1.rlike(REFERENCE_WORD)) & both(SECTION_NUMBER), "renumber")
        .when(citation & both(CITED), "renumber")
        .when(~both(WHOLE_NUMBER), "numeric")
        .when(both(CITATION) | both(EQUATION_NUMBER), "renumber")
        .when(before1.rlike(JOINING) & before2.rlike(WHOLE_NUMBER) & before3.rlike(REFERENCE_WORD), "renumber")
        .when(before1.rlike(LISTED) & before2.rlike(REFERENCE_WORD), "renumber")
        .otherwise("numeric")
    )


def name_version(name: str | Column) -> Column:
    """The version in a file name, such as v1.2 or v3r1; null if there is none."""
    found = F.regexp_extract(F.lower(name), f"(?:^|[^a-z])v({VERSION_NUMBER})", 1)
    return F.when(found != "", F.concat(F.lit("v"), F.replace(found, F.lit("_"), F.lit("."))))


def title_version(title: str | Column) -> Column:
    """The version that a title page states after "version" or "draft"; null if there is none."""
    found = F.regexp_extract(F.lower(title), rf"\b(?:version|draft)\s*v?({VERSION_NUMBER})\b", 1)
    return F.when(found != "", F.concat(F.lit("v"), F.replace(found, F.lit("_"), F.lit("."))))


def version_key(version: Column) -> Column:
    """The numbers of a version, for sorting; none for the empty version, which sorts last by `version_sort`."""
    parts = F.filter(F.split(version, "[._r]"), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("int"))


def same_version(a: Column, b: Column) -> Column:
    """Whether two keys agree but for zeros at their ends."""
    return trim_zeros(a) == trim_zeros(b)


def trim_zeros(key: Column) -> Column:
    last = F.aggregate(F.sequence(F.lit(1), F.size(key)), F.lit(1), lambda best, i: F.when(F.element_at(key, i) != 0, i).otherwise(best))
    return F.when(F.size(key) > 0, F.slice(key, F.lit(1), last)).otherwise(key)


def clip(text: str | Column, most: int) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def safe_name(name: str | Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\- ]+", "_")


def caption_kind(line: str | Column, small_font: Column, near_graphics: Column) -> Column:
    """figure, table or null, by how a line begins. After a full stop a caption needs four words, and small print or a
    graphic nearby."""
    kind, mark = F.regexp_extract(line, CAPTION, 1), F.regexp_extract(line, CAPTION, 3)
    rest = F.size(words(F.regexp_replace(line, CAPTION, "")))
    doubtful = (mark == ".") & ((rest < 4) | (~small_font & ~near_graphics))
    return F.when((kind == "") | doubtful, None).when(kind == "Table", "table").otherwise("figure")


def caption_number(line: str | Column) -> Column:
    return F.regexp_extract(line, CAPTION, 2)

"""Text normalisers as native column expressions.

Two dialects meet here. Question grouping uses the Unicode word class, which counts combining
marks and so keeps Indic vowel signs; Java needs ``(?U)`` for that. Intent text uses a narrower word
class (letters, numbers, underscore) plus the Devanagari block, spelled out below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a caller's question.
STOP_WORDS = (
    "the on a of information about to in asked me tell beneficiary beneficiaries please give "
    "checking and under how for provide know knowing your regarding ask related while"
).split()

# Rewrites of a lower-cased question, applied in this order. A phrase between bars
# matches whole words only; the words of a phrase may be any number of blanks apart.
# The stop words leave after the first rewrite.
QUERY_REWRITES = [
    ("|pm ksny|", ""),
    ("|pradhan mantri|", "|pm|"),
    ("|prime minister|", "|pm|"),
    ("|yojana|", "|scheme|"),
    ("|yojna|", "|scheme|"),
    ("pm kisan samman nidhi", "pmksn"),
    ("|pm kisan|", "|pmksn|"),
    ("kisan samman nidhi", "pmksn"),
]

# Spellings of one scheme name, applied in this order to intent text. The blanks
# are optional; a phrase between bars must stand between word boundaries.
SCHEME_VARIANTS = [
    "|pm kisan|",
    "|pm kisan samman nidhi|",
    "|pradhan mantri kisan|",
    "|pradhan mantri kisan samman nidhi|",
    "पीएम किसान",
    "प्रधान मंत्री किसान",
]
SCHEME_NAME = "pmkisan"

# District names that are only a direction.
DIRECTIONS = ["east", "west", "south", "north"]

_WORD = r"\p{L}\p{N}_"


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space on both sides (``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _own_blanks(phrase: str) -> str:
    # "|pm ksny|" -> " pm  ksny ": every word carries one blank on either side
    return phrase.replace(" ", "  ").replace("|", " ")


def _with(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` may name its argument several times without ``c`` being computed several times."""
    return F.element_at(F.transform(F.array(c), use), 1)


def norm_query(c: Column) -> Column:
    """Group key of a caller's question; null stays null.

    One Unicode pass cuts the text into words, written so that each word has a blank of its own on
    both sides. A whole-word rewrite is then a plain text replacement, which needs no regular
    expression, and neighbouring matches cannot share a blank.
    """

    def rewrite(text: Column, steps: list[tuple[str, str]]) -> Column:
        for phrase, repl in steps:
            text = F.replace(text, F.lit(_own_blanks(phrase)), F.lit(_own_blanks(repl)))
        return text

    words = F.regexp_replace(F.lower(c.cast("string")), r"(?U)\W+", "  ")
    text = rewrite(F.concat(F.lit(" "), words, F.lit(" ")), QUERY_REWRITES[:1])
    kept = F.filter(F.split(F.trim(text), "  "), lambda w: ~w.isin(STOP_WORDS))
    text = F.concat(F.lit(" "), F.array_join(kept, "  "), F.lit(" "))
    text = rewrite(text, QUERY_REWRITES[1:])
    status = " status "
    text = _with(
        text,
        lambda t: F.concat(
            F.when(F.contains(t, F.lit(status)), F.lit(status)).otherwise(F.lit("")),
            F.replace(t, F.lit(status), F.lit("")),
        ),
    )
    text = F.replace(text, F.lit(" scheme "), F.lit(""))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def norm_text(c: Column) -> Column:
    """Intent text: lower case, punctuation to blanks, scheme spellings unified; null becomes ''.

    Runs of blanks and punctuation become one blank at the start, so the later steps meet single
    blanks only. The look-behind of a word boundary follows the first letters of its phrase: the
    search then fails on one letter at most positions.
    """
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    text = F.regexp_replace(text, rf"[^{_WORD}\u0900-\u097F]+", " ")

    def unify(t: Column) -> Column:
        for variant in SCHEME_VARIANTS:
            phrase = variant.strip("|").replace(" ", " ?")
            if variant.startswith("|"):
                phrase = f"{phrase[:2]}(?<![{_WORD}]{phrase[:2]}){phrase[2:]}(?![{_WORD}])"
            t = F.regexp_replace(t, phrase, SCHEME_NAME)
        return t

    # every variant holds one of these two words; other texts skip the six searches
    touched = [F.lit("kisan"), F.lit("किसान")]
    return F.trim(
        _with(text, lambda t: F.when(F.contains(t, touched[0]) | F.contains(t, touched[1]), unify(t)).otherwise(t))
    )


def norm_key(c: Column) -> Column:
    """Place key: trimmed, lower case, no blanks."""
    return F.replace(F.lower(trim_ws(c.cast("string"))), F.lit(" "), F.lit(""))


def norm_name(c: Column) -> Column:
    """District name: trimmed, lower case, without blanks and hyphens."""
    return F.translate(F.lower(trim_ws(c)), " -", "")


def repair_name(c: Column) -> Column:
    """District name of a boundary file, whose font left three letters as symbols."""
    # Fixed values: | stands for i, @ for u, > for a; blank and hyphen are dropped.
    return F.translate(F.lower(trim_ws(c)), "|@> -", "iua")


def keep_directions(district: Column, state: Column) -> Column:
    """A district named only by a direction gets its state's name appended."""
    return F.when(district.isin(DIRECTIONS), F.concat(district, state)).otherwise(district)


def match_form(c: Column) -> Column:
    """The form two names are compared in: other signs to blanks, lower case, trimmed."""
    return trim_ws(F.lower(F.regexp_replace(c, rf"[^{_WORD}]", " ")))


def byte_length(c: Column) -> Column:
    """UTF-8 length of the trimmed text; null counts as empty."""
    return F.octet_length(trim_ws(F.coalesce(c.cast("string"), F.lit("")))).cast("bigint")


def preview(c: Column, n: int = 400) -> Column:
    return F.substring(trim_ws(c), 1, n)


def one_line(c: Column) -> Column:
    """A text on one line, as an embedder reads it."""
    return trim_ws(F.replace(c, F.lit("\n"), F.lit(" ")))


def tokens(c: Column) -> Column:
    """Words of a normalised text, which has single blanks only; empty for a blank text."""
    return F.filter(F.split(c, " "), lambda t: t != "")

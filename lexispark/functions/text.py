"""Text to terms, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small default list of function words; a collection's own list is a parameter.
STOP = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "did", "do",
    "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in", "into", "is", "it", "its", "may", "more", "no", "not", "of", "on",
    "or", "our", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we",
    "were", "what", "when", "which", "who", "will", "with", "would", "you",
)


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms: possessives, stop words, stemmer.

    ``stemmer`` is none, weak (first step of Porter), porter (canonical: only
    the longest matching suffix of a step is tried) or porter_all (every
    suffix of a step is tried in turn).
    """

    possessive: bool = False
    stop: tuple[str, ...] = STOP
    stemmer: str = "none"

    def __post_init__(self) -> None:
        if self.stemmer not in ("none", "weak", "porter", "porter_all"):
            raise ValueError(f"unknown stemmer {self.stemmer}")

    def terms(self, text: Column) -> Column:
        """Array of terms before stemming, in text order, repeats kept."""
        found = normalize(text) if self.possessive else alnum(text)
        return without_stop(found, self.stop) if self.stop else found

    def lowered(self, text: Column) -> Column:
        """The text whose maximal runs of a-z and 0-9 are the terms, stop words too."""
        low = F.lower(F.coalesce(text, F.lit("")))
        return strip_possessive(low) if self.possessive else low


def strip_possessive(text: Column) -> Column:
    """Delete every 's that no letter follows; the text is in lower case."""
    return F.regexp_replace(text, "'s(?![a-z])", "")


def split_alnum(lowered: Column) -> Column:
    """Maximal runs of a-z and 0-9; other letters separate."""
    return F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), F.lit(1))


def alnum(text: Column) -> Column:
    return split_alnum(F.lower(F.coalesce(text, F.lit(""))))


def normalize(text: Column) -> Column:
    """Lower-case, drop possessives, split."""
    return split_alnum(strip_possessive(F.lower(F.coalesce(text, F.lit("")))))


def without_stop(terms: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*stop))


def first_term(word: Column) -> Column:
    """The first piece of a query word, the empty string if it has none; stop words stay."""
    return F.coalesce(F.get(normalize(word), F.lit(0)), F.lit(""))


def clean_topic(text: Column) -> Column:
    """Lower-case, and every run of signs that are no letter or digit of any script is one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


FIELD_SETS = {"text": ("body",), "title_text": ("title", "body"), "all": ("title", "author", "bibliography", "body")}


def join_fields(names: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *names)


def variant_name(fields: str, stemmer: str, stop: str) -> str:
    return f"{fields}__{stemmer}__{stop}"


def model_name(model: str, controls: dict[str, float]) -> str:
    return f"{model}({', '.join(f'{k}={v}' for k, v in controls.items())})"


def controls_of(name: Column) -> tuple[Column, Column]:
    """k_1 and b from a model's name."""
    return tuple(F.regexp_extract(name, rf"\b{k}=([0-9.]+)", 1).cast("double") for k in ("k_1", "b"))


def percent_change(old: Column, new: Column) -> Column:
    return F.format_string("%+.1f%%", 100 * (new - old) / old)

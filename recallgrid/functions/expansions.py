"""Dictionaries that widen texts, and their use as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.extract import let

HYPERNYMS = {
    "yellowstone": "national_park", "yosemite": "national_park", "grand canyon": "national_park", "zion": "national_park", "glacier": "national_park",
    "everglades": "national_park", "sequoia": "national_park", "acadia": "national_park", "denali": "national_park", "rocky mountain": "national_park",
    "paris": "city", "london": "city", "tokyo": "city", "new york": "city",
    "bach": "classical_music", "beethoven": "classical_music", "mozart": "classical_music", "chopin": "classical_music",
    "picasso": "visual_art", "monet": "visual_art", "van gogh": "visual_art", "shakespeare": "literature", "hemingway": "literature", "tolkien": "literature",
    "python": "programming_language", "javascript": "programming_language", "rust": "programming_language", "java": "programming_language", "typescript": "programming_language",
    "labrador": "dog", "golden retriever": "dog", "siamese": "cat", "persian": "cat",
}
NOMINALS = {
    "camping": "camping trip", "hiking": "hiking trip", "fishing": "fishing trip", "traveling": "travel journey", "travelling": "travel journey",
    "reading": "reading hobby", "cooking": "cooking activity", "painting": "painting activity", "gardening": "gardening hobby", "swimming": "swimming activity",
    "running": "running exercise", "cycling": "cycling activity", "dancing": "dancing activity", "writing": "writing activity", "singing": "singing performance",
    "climbing": "climbing adventure", "surfing": "surfing activity", "skiing": "skiing trip", "snowboarding": "snowboarding trip", "volunteering": "volunteer work",
    "meditating": "meditation practice", "studying": "study session", "practicing": "practice session", "teaching": "teaching session", "learning": "learning experience",
    "exploring": "exploration adventure",
}
CONCEPTS = {
    "camping": ("outdoor_activity", "nature", "tent", "hiking", "national_park", "wilderness"),
    "hiking": ("outdoor_activity", "trail", "nature", "exercise", "mountain", "national_park"),
    "fishing": ("outdoor_activity", "water", "lake", "river", "nature", "patience"),
    "painting": ("art", "creative", "visual_art", "canvas", "artistic", "hobby"),
    "reading": ("book", "literature", "knowledge", "education", "hobby", "library"),
    "cooking": ("food", "kitchen", "recipe", "culinary", "meal", "hobby"),
    "gardening": ("plant", "nature", "outdoor_activity", "hobby", "flower", "garden"),
    "yoga": ("exercise", "meditation", "fitness", "health", "relaxation", "flexibility"),
    "running": ("exercise", "fitness", "marathon", "jogging", "sport", "cardio"),
    "swimming": ("water", "exercise", "pool", "sport", "fitness", "aquatic"),
    "piano": ("music", "instrument", "classical", "keyboard", "musical", "performance"),
    "violin": ("music", "instrument", "classical", "string", "orchestra", "musical"),
    "guitar": ("music", "instrument", "string", "acoustic", "musical", "performance"),
    "photography": ("camera", "art", "visual", "creative", "hobby", "image"),
    "travel": ("adventure", "tourism", "explore", "vacation", "journey", "destination"),
    "volunteering": ("charity", "community", "altruism", "helping", "service", "kindness"),
    "meditation": ("mindfulness", "relaxation", "mental_health", "calm", "peace", "spiritual"),
    "cycling": ("bicycle", "exercise", "sport", "fitness", "outdoor_activity", "commute"),
    "dancing": ("music", "art", "performance", "exercise", "rhythm", "movement"),
    "writing": ("literature", "creative", "author", "storytelling", "hobby", "expression"),
}


def expansions(text: Column) -> Column:
    """Hypernyms of names in the text and nominal forms of its gerunds, each once, in the order of the dictionaries.

    A gerund is looked for as a part of the text first, and only where it is one, as a whole word; texts are not cut into words.
    """

    def found(low: Column) -> Column:
        up = [F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in HYPERNYMS.items()]
        nouns = [F.when(F.contains(low, F.lit(k)) & low.rlike(f"(?<![a-z0-9_]){k}(?![a-z0-9_])"), F.lit(v)) for k, v in NOMINALS.items()]
        return F.array_distinct(F.array_compact(F.array(*up, *nouns)))

    return let(F.lower(text), found)


def concepts(words: Column, least_overlap: int = 0) -> Column:
    """Concepts of every word that the dictionary has, each once, sorted."""
    found = [F.when(F.array_contains(words, k), F.array(*map(F.lit, v))) for k, v in CONCEPTS.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*found)))))


def enriched(text: Column) -> Column:
    """The text and its expansions, appended in brackets; unchanged without any."""
    return let(expansions(text), lambda more: F.when(F.size(more) > 0, F.concat(text, F.lit(" ["), F.array_join(more, ", "), F.lit("]"))).otherwise(text))

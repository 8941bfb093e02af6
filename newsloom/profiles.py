"""The two rule profiles of the processing flow, written as data.

A band is ``(lowest value, points, label)``; bands are listed from best to worst and the first one
reached wins. Lengths count code points of the unstripped text.
"""

from __future__ import annotations

from dataclasses import dataclass

Band = tuple[int, int, str]


@dataclass(frozen=True)
class Profile:
    name: str
    length_bands: tuple[Band, ...]
    sentence_bands: tuple[Band, ...]
    keyword_bands: tuple[Band, ...]
    keywords: tuple[str, ...]
    headline_bands: tuple[Band, ...] = ()
    metadata_points: bool = False
    hash_covers_headline: bool = False
    drops_empty_content: bool = True
    keeps_hash: bool = True
    strict_reply: bool = False
    max_attempts: int = 1
    gate: int = 3


# Band limits, points, labels and keyword lists of both profiles.
PROFILE_A = Profile(
    name="A",
    length_bands=(
        (1000, 3, "excellent_length"),
        (500, 2, "good_length"),
        (200, 1, "adequate_length"),
        (0, 0, "insufficient_length"),
    ),
    sentence_bands=(
        (6, 2, "excellent_structure"),
        (3, 1, "good_structure"),
        (0, 0, "poor_structure"),
    ),
    keyword_bands=(
        (5, 3, "highly_technical"),
        (3, 2, "technical_content"),
        (1, 1, "some_technical"),
        (0, 0, "non_technical"),
    ),
    keywords=(
        "semiconductor", "chip", "manufacturing", "technology", "innovation",
        "processor", "silicon", "wafer", "fabrication", "electronics",
        "circuit", "transistor", "integrated", "microprocessor", "AI",
        "artificial intelligence", "machine learning", "quantum", "nanotechnology",
        "gallium", "arsenide", "nitride", "TSMC", "Intel", "AMD", "NVIDIA",
    ),
    metadata_points=True,
)

PROFILE_B = Profile(
    name="B",
    length_bands=(
        (1001, 3, "sufficient_length"),
        (501, 2, "moderate_length"),
        (201, 1, "short_length"),
        (0, 0, "very_short"),
    ),
    sentence_bands=(
        (6, 2, "well_structured"),
        (3, 1, "basic_structure"),
        (0, 0, "poor_structure"),
    ),
    keyword_bands=(
        (5, 3, "highly_relevant"),
        (2, 2, "relevant"),
        (1, 1, "somewhat_relevant"),
        (0, 0, "low_relevance"),
    ),
    keywords=(
        "semiconductor", "chip", "technology", "AI", "manufacturing", "processor",
        "memory", "GPU", "CPU", "silicon", "fabrication", "innovation", "research",
        "development", "market", "industry", "company", "investment", "revenue",
    ),
    headline_bands=(
        (21, 2, "good_headline"),
        (1, 1, "basic_headline"),
        (0, 0, "no_headline"),
    ),
    hash_covers_headline=True,
    drops_empty_content=False,
    keeps_hash=False,
    strict_reply=True,
    max_attempts=2,
)

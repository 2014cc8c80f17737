"""Options of normalization, matching and processing, as plain driver-side values."""

from __future__ import annotations

from dataclasses import dataclass

TAG_FORMATS = ("xml", "markdown", "bracket")
PROMPT_FORMATS = (*TAG_FORMATS, "minimal")


@dataclass(frozen=True)
class NormalizationOptions:
    """Which steps ``normalize_arabic`` applies."""

    remove_diacritics: bool = True
    normalize_alef: bool = True
    normalize_alef_maqsura: bool = True
    normalize_teh_marbuta: bool = True
    remove_tatweel: bool = True
    normalize_hamza: bool = True
    normalize_whitespace: bool = True


#: Keys of the inverted index keep marks and tatweel.
INDEX_OPTIONS = NormalizationOptions(remove_diacritics=False, remove_tatweel=False)


@dataclass(frozen=True)
class ValidatorOptions:
    """How quotes are matched against the corpus."""

    fuzzy_threshold: float = 0.8
    max_suggestions: int = 3
    include_partial: bool = True
    min_detection_length: int = 10

    def __post_init__(self) -> None:
        if self.max_suggestions < 0 or self.min_detection_length < 0:
            raise ValueError("max_suggestions and min_detection_length must not be negative")


@dataclass(frozen=True)
class ProcessorOptions:
    """How whole texts are processed."""

    auto_correct: bool = True
    min_confidence: float = 0.85
    scan_untagged: bool = True
    tag_format: str = "xml"

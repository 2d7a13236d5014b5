"""Types of records and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

#: What is read from a crawl line; unknown keys are dropped.
RECORD = (
    "url string, text string, html string, title string, language string, crawled_at string, "
    "quality string, signatures string, embedding array<float>, meta string"
)
LEVELS = ("raw", "normalized", "structural")
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


@dataclass(frozen=True)
class Settings:
    """Settings of a run, with the defaults of the engine this one is compatible with."""

    adapt_to_script: bool = True
    bands: int = 32
    exact_level: str = "normalized"
    min_block_chars: int = 25
    near_dup_threshold: float = 0.80
    ngram: int = 5
    num_perm: int = 128
    run_near_dedup: bool = True
    run_quality: bool = True
    unicode_form: str = "NFKC"

    def __post_init__(self) -> None:
        if self.exact_level not in LEVELS:
            raise ValueError(f"exact_level must be one of {LEVELS}")
        if self.num_perm < 1 or self.bands < 1 or self.num_perm % self.bands:
            raise ValueError("bands must divide num_perm")
        if self.unicode_form not in FORMS:
            raise ValueError(f"unicode_form must be one of {FORMS}")

"""Parameters of the operators, with the defaults the published behaviour uses."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleaningConfig:
    """Switches of the text cleaner; every step is on by default."""

    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    strip_non_alphanumeric: bool = True
    remove_stopwords: bool = True


@dataclass(frozen=True)
class Settings:
    """Immutable run parameters shared by the operators."""

    # split
    test_size: float = 0.15
    validation_size: float = 0.15
    seed: int = 42
    # vectoriser
    max_features: int = 20000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2
    max_df: float = 0.95
    sublinear_tf: bool = True
    # text
    cleaning: CleaningConfig = CleaningConfig()
    max_input_chars: int = 50000
    # confidence levels
    high_confidence: float = 0.85
    medium_confidence: float = 0.65
    # tuning
    enable_tuning: bool = True
    cv_folds: int = 5
    search_type: str = "grid"
    random_search_iterations: int = 20


DEFAULTS = Settings()

# Label coding and names.
REAL, FAKE = 0, 1
LABEL_NAMES = {REAL: "REAL", FAKE: "FAKE"}

# The nine stylistic features, in column order.
NUMERIC_FEATURES = [
    "word_count",
    "char_count",
    "sentence_count",
    "avg_word_length",
    "uppercase_ratio",
    "punctuation_count",
    "url_count",
    "exclamation_count",
    "question_count",
]

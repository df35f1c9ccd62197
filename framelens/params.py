"""Parameters of the analysis, with the defaults of the original study."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original study's values for the results
# to agree; they are listed here as plain text, in their natural order.
# ---------------------------------------------------------------------------

# Lines containing one of these phrases (case-insensitive) are boilerplate.
BOILERPLATE_PHRASES = (
    "social sharing",
    "©",
    "all rights reserved",
    "abonnez-vous",
    "sign up for",
    "newsletter",
    "cookie",
    "subscribe now",
)

# Terms never removed as stopwords.
PROTECTED_TERMS = ("4chan", "meme", "memes", "8chan", "anon", "imageboard")

# Languages kept from the detector; anything else falls back to the hint.
ACCEPTED_LANGUAGES = ("en", "fr")

# Language names in discovery responses mapped to codes.
LANGUAGE_NAMES = (("english", "en"), ("french", "fr"))

# Reading rule for the effect size.
EFFECT_BANDS = ((0.5, "large"), (0.3, "medium"), (0.1, "small"))

# The frame codebook of the study protocol (six labels).
CODEBOOK = (
    "meme_internet_culture",
    "far_right_extremism",
    "violence_crime",
    "platform_tech",
    "politics_elections",
    "other",
)

# Delivered frame annotation: topic id -> frame label (22 rows).
FRAME_ANNOTATION = (
    (0, "violence_crime"),
    (1, "violence_crime"),
    (2, "incel_misogyny"),
    (3, "far_right_extremism"),
    (4, "far_right_extremism"),
    (5, "politics_elections"),
    (6, "conspiracy_qanon"),
    (7, "meme_internet_culture"),
    (8, "platform_tech"),
    (9, "far_right_extremism"),
    (10, "far_right_extremism"),
    (11, "meme_internet_culture"),
    (12, "conspiracy_qanon"),
    (13, "meme_internet_culture"),
    (14, "platform_tech"),
    (15, "incel_misogyny"),
    (16, "meme_internet_culture"),
    (17, "politics_elections"),
    (18, "politics_elections"),
    (19, "platform_tech"),
    (20, "conspiracy_qanon"),
    (-1, "outlier"),
)

# Notes of the chi-square result.
NOTE_NOT_APPLICABLE = "Need >=2 languages and >=2 frames; test not applicable."
NOTE_SMALL_EXPECTED = (
    "Warning: >20% of expected cell counts are < 5 — the chi-square "
    "approximation is unreliable here; treat the p-value with caution "
    "(consider Fisher's exact test or a larger corpus)."
)


@dataclass(frozen=True)
class Params:
    min_chars: int = 200
    accepted_languages: tuple = ACCEPTED_LANGUAGES
    label_train_mod: int = 2             # rows with doc_id % this = 0 are labelled training rows
    protected_terms: tuple = PROTECTED_TERMS
    ngram_max: int = 2
    min_df: int = 2                      # in >= 2 topics (class documents)
    strategy: str = "unified"            # or "split"
    n_components: int = 5
    min_cluster_size: int = 5
    min_samples: int = 1
    eps_cosine: float = 0.36
    projection_dims: int = 64            # singular vectors kept of the hashed text vectors
    eps_reduced: float = 0.95            # cosine of linked texts after the reduction
    nr_topics: int | None = None
    seed: int = 42
    representative_docs: int = 10
    keywords_per_topic: int = 10
    name_words: int = 4
    max_time_bins: int = 20
    top_topics_over_time: int = 10
    words_over_time: int = 5
    alpha: float = 0.05
    small_cell_share: float = 0.2
    host_spacing_s: float = 7.0
    paragraph_min: int = 40              # strictly longer
    body_min: int = 200                  # at least
    discovery_limit: int = 250
    default_snapshot_date: str = "20200101"
    hot_key_salt: int = 64               # salt buckets for skew-safe top-k
    boilerplate: tuple = field(default=BOILERPLATE_PHRASES)


DEFAULT = Params()

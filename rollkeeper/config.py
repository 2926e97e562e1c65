"""Thresholds and vocabularies, all overridable through the dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

PRESENT = "PRESENT"
ABSENT = "ABSENT"
LATE = "LATE"
UNMARKED = "UNMARKED"

MATCHED = "MATCHED"
NEEDS_REVIEW = "NEEDS_REVIEW"
UNMATCHED = "UNMATCHED"

ROLL_NO = "ROLL_NO"
STUDENT_ID = "STUDENT_ID"
NAME = "NAME"
ATTENDANCE = "ATTENDANCE"
COLUMN_TYPES = (ROLL_NO, STUDENT_ID, NAME, ATTENDANCE)


@dataclass(frozen=True)
class MatchConfig:
    # Confidences and thresholds of the matching rules.
    conf_student_id: float = 1.00
    conf_roll_number: float = 0.98
    conf_enrollment: float = 0.98
    conf_exact_name: float = 0.95
    conf_normalized_name: float = 0.90
    conf_ambiguous: float = 0.50
    fuzzy_accept: float = 0.88
    fuzzy_margin: float = 0.12
    fuzzy_candidate: float = 0.60
    fuzzy_first_word: float = 0.70
    fuzzy_last_word: float = 0.60
    fuzzy_match_weight: float = 0.90
    fuzzy_review_weight: float = 0.70
    fuzzy_kept: int = 5
    review_below: float = 0.65
    use_fuzzy: bool = True


@dataclass(frozen=True)
class LayoutConfig:
    # Pixel tolerances of the layout rules.
    header_reach: float = 30.0
    header_gap: float = 2.0
    anchor_gap: float = 5.0
    footer_gap: float = 5.0
    left_zone: float = 0.40
    side_margin: float = 25.0
    filter_margin: float = 10.0
    rule_line_width: float = 50.0
    min_height: float = 5.0
    id_column_margin: float = 15.0
    anchor_margin: float = 10.0
    same_row: float = 16.0
    outside_band: float = 0.90
    cluster_factor: float = 0.70
    cluster_low: float = 12.0
    cluster_high: float = 22.0
    overlap_slack: float = 8.0


@dataclass(frozen=True)
class UploadConfig:
    # Upload limits.
    max_bytes: int = 10 * 1024 * 1024
    min_side: int = 50
    content_types: tuple = ("image/jpeg", "image/jpg", "image/png", "image/webp")
    extensions: tuple = (".jpg", ".jpeg", ".png", ".webp")

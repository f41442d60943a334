"""Tunable values of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # alignment
    embedding_similarity: float = 0.75
    tight_distance: float = 0.02
    loose_distance: float = 0.15
    least_embedded_length: int = 2
    geometry_distance_named: float = 0.3
    geometry_distance_unnamed: float = 0.03
    # warnings
    low_key_rate: float = 0.5
    least_keyed: int = 20
    low_keyed_fraction: float = 0.05
    least_elements: int = 20
    # retrieval
    retrieved: int = 20
    answered_from: int = 5
    # recognised words
    ocr_confidence: float = 60.0
    ocr_dpi: int = 300
    vision_regions: int = 40
    vision_confidence: float = 0.9
    dimension_decimals: int = 1
    # cost per million tokens, upload cap in bytes, evaluation
    cost_in: float = 3.0
    cost_out: float = 15.0
    upload_cap: int = 50 * 1024 * 1024
    fuzzy_ratio: float = 0.85


DEFAULT = Settings()

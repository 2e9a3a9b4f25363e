"""Thresholds of all checks, in one place. Pass a changed copy (``replace``) to an operator to override some."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # time axis and synchronisation
    gap_factor: float = 5.0  # an interval above this many medians is a gap
    frame_loss: float = 0.02
    drift_ms_per_s: float = 0.5
    residual_ratio: float = 0.5  # of the fastest stream's interval
    static_min_samples: int = 100
    baseline_min_coverage: float = 0.95
    gap_report_limit: int = 20
    burst_ratio: float = 3.0
    rate_tolerance: float = 0.05
    spread_quantiles: bool | None = None  # exact medians in several passes: always, never, or (None) for large tables
    # sensor sanity
    static_variation: float = 0.02
    static_share_warn: float = 0.05
    gravity_tolerance: float = 0.1
    clipping: float = 0.05
    constant_variation: float = 1e-6
    bad_values: float = 0.05
    block_rate: float = 100.0
    # statistics
    outlier_k: float = 1.5
    # dataset quality
    gate_bad_values: float = 0.05
    gate_frame_loss: float = 0.02
    gate_schema_mismatch: int = 0
    spike_factor: float = 15.0
    saturation: float = 7.0
    idle_speed: float = 0.1
    idle_share: float = 0.6
    path_efficiency: float = 0.3
    jerk_ratio: float = 0.3
    pause_steps: int = 30
    shake_ratio: float = 0.3
    report_limit: int = 10
    # segmentation and annotations
    min_segment_s: float = 0.5
    max_segment_s: float = 60.0
    change_point_ratio: float = 3.0
    segment_idle_speed: float = 0.1
    min_pause_steps: int = 5
    max_gap_s: float = 0.1
    # documents
    read_max_chars: int = 4000


DEFAULTS = Settings()

"""Named choices of each kind of step: plain dictionaries of functions."""

from __future__ import annotations

from collections.abc import Callable

from framelane.operators import evaluate, features, interpolate, modelling, pixels, series, smooth

KINDS: dict[str, dict[str, Callable]] = {
    "preprocessor": {"log_dr": pixels.compress_range, "tgc": pixels.depth_gain},
    "repair": {"gaps": interpolate.fill_gaps, "query_frames": interpolate.repair, "backoff": interpolate.fill_with_backoff},
    "size_rule": smooth.SIZE_RULES,
    "evaluator": {"video_summary": evaluate.video_summary, "detection": evaluate.detection_counts},
    "extractor": {
        "motion": features.motion,
        "motion_lite": features.motion_lite,
        "motion_curve": features.motion_curve,
        "static": features.static,
        "static_extra": features.static_extra,
        "geometry": features.geometry,
        "geometry_series": series.geometry_series,
        "derived_series": series.derived_series,
        "box_series": series.box_series,
        "lite_series": series.lite_series,
    },
    "classifier": modelling.CLASSIFIERS,
}


def register(kind: str, name: str, fn: Callable) -> None:
    if name in KINDS.setdefault(kind, {}):
        raise ValueError(f"{kind} {name!r} is taken")
    KINDS[kind][name] = fn


def get(kind: str, name: str) -> Callable:
    try:
        return KINDS[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; known: {sorted(KINDS.get(kind, {}))}") from None

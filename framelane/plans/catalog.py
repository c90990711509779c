"""Imports every query module, so that the registry is complete."""

from framelane.plans import q_associate, q_classify, q_confidence, q_evaluate, q_features, q_frames, q_models, q_pixels, q_reconstruct, q_report, q_series, q_smooth, q_sources, q_stream, q_trajectory  # noqa: F401
from framelane.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401

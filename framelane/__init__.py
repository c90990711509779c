"""Trajectory and model-evaluation analytics as Spark DataFrame functions."""

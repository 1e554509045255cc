"""Offline policy evaluation on Spark: trajectories, estimators, diagnostics and gates."""

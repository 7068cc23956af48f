"""Anomaly models. Every model scores a table with an array column ``x`` and returns the table
with ``anomaly_score`` added (higher is more anomalous)."""

"""Relational and stateful operators over spans, logs, metrics and their rollups."""

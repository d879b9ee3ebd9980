"""Operators of a training-data pipeline: de-duplication, language, extraction, scoring, scans, packing."""

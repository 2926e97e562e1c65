"""Intake of uploads, OCR output, rosters, records, saved pages and session data."""

"""The steps of extraction, matching, reporting and roster updates."""

"""Training-data operators: extraction, scans, filters, duplicates, search, tokens and mixing."""

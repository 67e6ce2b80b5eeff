"""Training-data operators: quality rules, near-duplicate search, tokens, licences, filters."""

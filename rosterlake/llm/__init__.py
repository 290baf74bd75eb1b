"""Training-data operators: scoring, language ID, tokenization, records, licences, mixing, search, media, sharding, near-duplicates."""

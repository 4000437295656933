"""Training-data operators: mixing, scoring, near-duplicates, tokens, licences, URLs, shards, rules."""

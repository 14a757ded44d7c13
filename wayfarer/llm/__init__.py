"""Training-data operators: mixing, language ID, dedup, extraction, sharding, archives, licences."""

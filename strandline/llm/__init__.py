"""Operations of a training-data pipeline: scoring, near-duplicates, secrets, search, packing."""

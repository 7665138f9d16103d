"""Operations of a training-data pipeline: extraction, archives, scoring, encoding, search,
packing, near-duplicates, media columns, quality and secrets."""

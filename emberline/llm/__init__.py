"""Operations of a training-data pipeline: deduplication, filters, extraction, scoring and mixing."""

"""Operations of a training-data pipeline: filters, deduplication, scans, counts and mixing."""

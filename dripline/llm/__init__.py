"""Operations of a training-data pipeline: filters, mixing, near-duplicates, tokens, language models, search."""

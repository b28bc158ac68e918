"""Operations of a training-data pipeline: rules, extraction, sharding, tokens, search, archives, dedup, language, mixing, secrets."""

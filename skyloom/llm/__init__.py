"""Training-data operators: mixing, similarity, cleaning, language, tokens, privacy, licences, pages, quality, media."""

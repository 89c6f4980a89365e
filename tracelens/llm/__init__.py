"""Training-data operators: licences, PII, quality, language, near copies, decontamination, mixing, sharding."""

"""Training-data operators: language id, near-dedup, LM scoring, decontamination, quality rules,
preference formatting, PII, quality classifier, source mixing and line dedup."""

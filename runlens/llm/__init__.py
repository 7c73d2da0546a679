"""Training-data operators (decontamination, near duplicates, tokens, PII, ...) and their driver queries."""

"""Training-data operators: mixing, quality, token files, near duplicates, packing, secrets,
fingerprints, repetition rules, repeated byte strings and toxicity."""

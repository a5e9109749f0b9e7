"""Training-data operators: PII, fingerprints, tokenising, search, near and exact
deduplication, toxicity, mixing, secrets, quality, fill-in-middle, source
divergence and benchmark decontamination.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""

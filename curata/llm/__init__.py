"""Training-data operators: fingerprints, near duplicates, exact top-k search,
secret scans, BPE, toxicity, packing, HTML extraction, substring and line
deduplication.  Nothing outside this folder imports it."""

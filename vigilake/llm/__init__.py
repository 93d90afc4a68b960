"""Training-data operators: near-duplicates, codecs, scans, formatting, extraction, packing."""

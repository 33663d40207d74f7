"""Training-data operators: licence scans, token counts, media chunking, fixity audits,
chat formatting, source mixing, byte-level BPE, toxicity, fingerprints, Jaccard joins.

Nothing outside this subpackage imports it.
"""

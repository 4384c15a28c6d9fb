"""Operators of a training-data pipeline: language ID, WARC records, sharding,
decontamination, near duplicates, URL filters, fingerprints, licence scans,
token counts, packing,
source mixing, periodic runs and spelling variants. Nothing outside this folder imports it."""

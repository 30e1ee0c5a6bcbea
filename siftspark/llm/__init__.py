"""Training-data operators: classifier, deduplication, search, packing, scans, filters, tokenising."""

"""Training-data operators over ``documents``: dedup, filters, scans, packing."""

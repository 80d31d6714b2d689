"""Training-data operators: quality, dedup, scoring, decontamination, packing and scans."""

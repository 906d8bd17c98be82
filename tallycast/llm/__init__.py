"""Operators for preparing text corpora: filters, near-duplicates, decontamination, scoring, packing, archives."""

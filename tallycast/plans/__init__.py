"""Whole pipelines: ledger in, one fitted row per entity out, and the tables made of it."""

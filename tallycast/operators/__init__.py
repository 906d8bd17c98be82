"""The relational and time-series operators."""

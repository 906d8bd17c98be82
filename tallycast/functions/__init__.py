"""Column expressions: text parsing, calendars, array arithmetic, labels."""

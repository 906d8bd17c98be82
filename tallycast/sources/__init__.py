"""Reading ledgers from files and writing results to files."""

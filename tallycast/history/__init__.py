"""Tables of files, predictions and anomalies, and the questions asked of them."""

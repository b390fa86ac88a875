"""Training-data preparation: ten corpus operators and their queries."""

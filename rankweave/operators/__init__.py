"""Sets, sequences, prefix-coded sequences, points and histograms, as tables and queries on them."""

"""Ways to rank, find and index at scale that the operators share."""

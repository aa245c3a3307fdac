"""Models read from tables, packed forms, scratch folders."""

"""Training-data operators: cleaning, deduplication, tokenisation and scoring of
large text tables.  Nothing outside this subpackage imports it."""

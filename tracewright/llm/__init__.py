"""Operators for building training corpora: archives, mixing, line dedup,
language ID, LM scoring, decontamination, SimHash, token output, embeddings
and secret scans.  Nothing else in the library imports this subpackage."""

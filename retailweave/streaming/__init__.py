"""Streaming forms of the incremental flows; each gives the rows of its batch operator."""

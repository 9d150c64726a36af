"""Readers and writers: FASTA, SAM, library lists, coverage files, AGP, BED, logs."""

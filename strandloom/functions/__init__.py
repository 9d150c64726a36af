"""Column functions: nucleotide strings, node-pair keys, thresholds."""

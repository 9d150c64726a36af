"""Nucleotide strings as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

# IUPAC codes with their complements, and the base that each code collapses to in two-bit storage.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
COLLAPSES_FROM = "MRWVHDSYBK"
COLLAPSES_TO = "AAAAAACCCG"


def revcomp(seq):
    """IUPAC reverse complement, case kept."""
    return F.translate(F.reverse(seq), IUPAC, COMPLEMENT)


def collapsed(seq):
    """Upper case, ambiguity codes replaced by the base they are stored as, all else by A."""
    return F.regexp_replace(F.translate(F.upper(seq), COLLAPSES_FROM, COLLAPSES_TO), "[^ACGT]", "A")


def digits(code, k: int):
    """A k-mer's numeric code as its k digits in base four."""
    return F.lpad(F.conv(code.cast("string"), 10, 4), k, "0")


def wrapped(seq, width: int = 60):
    """seq in lines of `width`, each ended by a line feed."""
    return F.regexp_replace(seq, f"(.{{1,{width}}})", "$1\n")


def sequence_of(text):
    """A nucleotide string made from prose: its letters a-z, folded onto ACGT."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("ACGT" * 7)[:26])

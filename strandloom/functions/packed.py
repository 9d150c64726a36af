"""Nucleotide strings at two bits a base, as column expressions.

A packed sequence is a struct: `bits` (four bases a byte, A C T G as 0 to 3), `skip` (bases before the first one that counts), `n` (its length) and `runs`: what two bits
can't say, as places and codes (ambiguity codes, lower case, anything else). Substring and reverse complement work on the packed form: the first
takes the bytes it needs and moves skip, the second turns the bits around. unpacked() gives the very string back, unpacked(exact=False) the one
that two-bit storage holds, in which such codes are collapsed to a base.

Defined results: null gives null; an empty string has no bits; places count from 0; a substring beyond the end is cut there, a negative start counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import collapsed, revcomp

#: Two bases a hexadecimal digit; A C T G are 0 1 2 3, so a complement is the digit with its upper bit turned.
_HEX = "0123456789ABCDEF"
_TURNED = "".join(_HEX[(d & 3 ^ 2) << 2 | d >> 2 ^ 2] for d in range(16))


def _bound(value: Column, f) -> Column:
    """f(value), where the value is worked out once however often f names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(seq: Column) -> Column:
    """(at, codes) of the stretches that aren't upper-case A, C, G or T."""
    codes, sizes = F.regexp_extract_all(seq, F.lit("[^ACGT]+"), F.lit(0)), F.transform(F.split(seq, "[^ACGT]+"), F.length)
    # Before run i stand the plain stretches up to i and the runs before it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,codes:string>>").alias("out"))

    def add(acc, x):
        at = acc["at"] + x["size"]
        return F.struct((at + F.length(x["codes"])).alias("at"), F.array_append(acc["out"], F.struct(at.alias("at"), x["codes"].alias("codes"))).alias("out"))

    pairs = F.zip_with(codes, F.slice(sizes, F.lit(1), F.size(codes)), lambda c, n: F.struct(n.alias("size"), c.alias("codes")))
    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def pack(seq: Column) -> Column:
    """The packed form of a string."""
    digits = F.translate(collapsed(seq), "ACTG", "0123")
    # 16 bases a number of 32 bits; the last one is filled up behind.
    words = F.transform(F.regexp_extract_all(digits, F.lit(".{1,16}"), F.lit(0)), lambda w: F.lpad(F.conv(F.rpad(w, 16, "0"), 4, 16), 8, "0"))
    hexed = F.substring(F.array_join(words, ""), F.lit(1), 2 * F.ceil(F.length(seq) / 4).cast("int"))
    return F.when(seq.isNotNull(), F.struct(F.unhex(hexed).alias("bits"), F.lit(0).alias("skip"), F.length(seq).alias("n"), _runs(seq).alias("runs")))


def unpacked(p: Column, exact: bool = True) -> Column:
    """The string of a packed sequence."""

    def plain(p):
        words = F.regexp_extract_all(F.hex(p["bits"]), F.lit(".{1,8}"), F.lit(0))
        digits = F.array_join(F.transform(words, lambda w: F.lpad(F.conv(w, 16, 4), (2 * F.length(w)).cast("int"), F.lit("0"))), "")
        return F.translate(F.substring(digits, p["skip"] + 1, p["n"]), "0123", "ACTG")

    def whole(p, text):
        done = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def put(acc, r):
            return F.struct((r["at"] + F.length(r["codes"])).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, r["at"] - acc["at"]), r["codes"])).alias("out"))

        put_all = F.aggregate(p["runs"], done, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.greatest(p["n"] - acc["at"], F.lit(0)))))
        return F.when(F.size(p["runs"]) > 0, put_all).otherwise(text)

    if not exact:
        return _bound(p, plain)
    return _bound(p, lambda p: _bound(plain(p), lambda text: whole(p, text)))


def substring(p: Column, start: Column, length: Column) -> Column:
    """length bases from `start` (from 0): the bytes that hold them, and no others."""

    def cut_out(p, a, n):
        first = p["skip"] + a
        byte, skip = F.floor(first / 4).cast("int"), first % 4
        bits = F.substring(p["bits"], byte + 1, F.ceil((skip + n) / 4).cast("int"))

        def cut(r):
            lo, hi = F.greatest(r["at"], a), F.least(r["at"] + F.length(r["codes"]), a + n)
            return F.struct((lo - a).cast("int").alias("at"), F.substring(r["codes"], lo - r["at"] + 1, F.greatest(hi - lo, F.lit(0))).alias("codes"))

        runs = F.filter(F.transform(p["runs"], cut), lambda r: r["codes"] != "")
        return F.when(p.isNotNull(), F.struct(bits.alias("bits"), skip.alias("skip"), n.alias("n"), runs.alias("runs")))

    def span(p):
        a = F.least(F.greatest(start, F.lit(0)), p["n"]).cast("int")
        return F.struct(a.alias("a"), F.greatest(F.least(length, p["n"] - a), F.lit(0)).cast("int").alias("n"))

    return _bound(p, lambda p: _bound(span(p), lambda x: cut_out(p, x["a"], x["n"])))


def reverse_complement(p: Column) -> Column:
    """The other strand: every two-base digit is turned and complemented, and their order reversed."""

    def turned(p):
        bits = F.unhex(F.translate(F.reverse(F.hex(p["bits"])), _HEX, _TURNED))
        skip = 4 * F.octet_length(p["bits"]) - p["skip"] - p["n"]
        runs = F.reverse(F.transform(p["runs"], lambda r: F.struct((p["n"] - r["at"] - F.length(r["codes"])).cast("int").alias("at"), revcomp(r["codes"]).alias("codes"))))
        return F.when(p.isNotNull(), F.struct(bits.alias("bits"), skip.cast("int").alias("skip"), p["n"].alias("n"), runs.alias("runs")))

    return _bound(p, turned)

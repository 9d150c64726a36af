"""Packed sequences against plain strings."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strandloom.functions import dna, packed


def rows():
    rng = random.Random(5)
    out = ["", "A", "ACGT", "NNNN", "acgt", "ACGTN", "NACGTRYacgtTTTT-*", None, "é?A"]
    out += ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 70))) for _ in range(60)]
    out += ["".join(rng.choice("ACGTACGTACGTNnRa") for _ in range(rng.randint(0, 70))) for _ in range(60)]
    return out + ["".join(rng.choice("ACGT") for _ in range(50_000)) + "N" * 30 + "ACGT" * 1000]


def test_round_trip_and_strands(spark):
    rng = random.Random(6)
    data = [(s, rng.randint(-3, 75), rng.randint(0, 40)) for s in rows()]
    d = spark.createDataFrame(data, "s string, a int, n int").withColumn("p", packed.pack(F.col("s")))
    p, a, n = F.col("p"), F.col("a"), F.col("n")
    part = packed.substring(p, a, n)
    got = d.select(
        "s", "a", "n", packed.unpacked(p).alias("back"), packed.unpacked(p, exact=False).alias("two_bit"), dna.collapsed(F.col("s")).alias("collapsed"), packed.unpacked(part).alias("part"),
        packed.unpacked(packed.reverse_complement(p)).alias("other"), dna.revcomp(F.col("s")).alias("revcomp"), packed.unpacked(packed.reverse_complement(packed.reverse_complement(part))).alias("twice"),
        packed.unpacked(packed.substring(packed.reverse_complement(p), a, n)).alias("other_part"), F.octet_length("p.bits").alias("size"), F.octet_length(part["bits"]).alias("part_size"),
    ).collect()
    assert len(got) == len(data)
    for r in got:
        if r.s is None:
            assert r.back is None and r.part is None and r.other is None
            continue
        lo = max(r.a, 0)
        assert r.back == r.s and r.two_bit == r.collapsed and r.other == r.revcomp
        assert r.part == r.s[lo : lo + r.n] == r.twice and r.other_part == r.revcomp[lo : lo + r.n]
        assert r.size == (len(r.s) + 3) // 4 and r.part_size <= r.n // 4 + 2


@settings(max_examples=200)
@given(st.integers(0, 15))
def test_digits_turn_to_the_other_strand(d):
    bases = "ACTG"
    two = bases[d >> 2] + bases[d & 3]
    turned = packed._TURNED[d]
    x = int(turned, 16)
    assert bases[x >> 2] + bases[x & 3] == two[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_many_runs_cost_no_pass_over_the_sequence_each(spark):
    import time

    def seconds(text):
        d = spark.createDataFrame([(text,)] * 4, "s string").repartition(4).select(packed.pack(F.col("s")).alias("p"))
        out = d.select(packed.unpacked(F.col("p")).alias("s"))
        assert {r.s for r in out.collect()} == {text}
        begin = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    assert seconds("AN" + "ACGT" * 20_000) * 20 + 10 > seconds("ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTNACG" * 1000)

"""A whole run on a synthetic genome with a known order."""

import random
from dataclasses import replace

from strandloom.config import DEFAULT
from strandloom.kernels.gaps import revcomp
from strandloom.plans import pipeline


def test_recovers_order_and_gaps(spark, tmp_path):
    rng = random.Random(11)
    n, size, gap = 6, 3000, 400
    genome = "".join(rng.choice("ACGT") for _ in range(n * (size + gap)))
    contigs = []
    for i in range(n):
        seq = genome[i * (size + gap) : i * (size + gap) + size]
        contigs.append(revcomp(seq) if i % 3 == 0 else seq)
    (tmp_path / "c.fa").write_text("".join(f">c{i}\n{s}\n" for i, s in enumerate(contigs)))
    reads, sam = [], []

    def place(at):
        """Contig, position and strand of 200 genome bases, if they lie in one contig."""
        i, off = divmod(at, size + gap)
        if off + 200 > size or i >= n:
            return None
        return (i, size - off - 200, True) if i % 3 == 0 else (i, off, False)

    for r in range(160):
        a = rng.randrange(0, len(genome) - 9000)
        seq = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in genome[a : a + 9000])
        reads.append(f">{r}\n{seq}\n")
        for start in range(0, 9000 - 2000, 150):
            one, two = place(a + start), place(a + start + 1800)
            if one and two:
                name = f"{r}_FG_2000_{start}"
                for (i, pos, flip), back in ((one, False), (two, True)):
                    sam.append(f"{name}\t{16 if flip != back else 0}\tc{i}\t{pos}\t60\t200M")
    (tmp_path / "r.fa").write_text("".join(reads))
    (tmp_path / "lib.sam").write_text("@HD\n" + "\n".join(sam) + "\n")
    (tmp_path / "list").write_text(f"{tmp_path}/lib.sam\t2000\t200\n")
    (tmp_path / "cov").write_text("".join(f"c{i} 10.0\n" for i in range(n)))
    s = pipeline.run(spark, str(tmp_path / "c.fa"), str(tmp_path / "r.fa"), str(tmp_path / "list"), str(tmp_path / "out"), str(tmp_path / "cov"), config=replace(DEFAULT, mlp=1500))
    walk = [(r.name, r.plus) for r in s.steps_validated.filter("is_contig").orderBy("idx").collect()]
    want = [(f"c{i}", i % 3 != 0) for i in range(n)]
    assert walk in (want, [(c, not p) for c, p in reversed(want)])
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "out.fa")).collect() if not r.value.startswith(">"))
    whole = genome[: n * (size + gap) - gap]
    text = text if walk == want else revcomp(text)
    from strandloom.kernels.align import semi_global

    assert abs(len(text) - len(whole)) < 30 and semi_global(text, whole)[0] < 60
    agp = spark.read.csv(str(tmp_path / "out.val.agp"), sep="\t").collect()
    assert len(agp) == 2 * n - 1
    assert len(spark.read.csv(str(tmp_path / "out.gaps"), sep=" ").collect()) == n - 1

"""Archives are compressed at the quickest level and read back whole."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

from strandloom.llm import warc


def test_quickest_level(spark, tmp_path):
    rng = random.Random(12)
    said = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, f"http://a.example/{i}", "<p>" + " ".join(rng.choices(said, k=2000)) + "</p>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    at = warc.write_records(warc.arc_rows(pages), str(tmp_path / "arc"), "\n")
    (file,) = Path(at).glob("*.gz")
    raw = zlib.decompress(file.read_bytes(), 31)
    assert all(h.encode() in raw for _, _, h in rows)
    quick, usual = len(zlib.compress(raw, 1)), len(zlib.compress(raw, 6))
    assert quick > 1.05 * usual and file.stat().st_size > (quick + usual) / 2

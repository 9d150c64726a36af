"""Language ID by compression: the language whose raw-content zstandard dictionary makes a text smallest.

Each language's dictionary is filled from a bounded sample of labelled rows: about 2 * `sample_docs` rows of a language, drawn by a hash of
their id and text (repeated rows are drawn once), at most `doc_bytes` bytes of each and `dict_bytes` in all. Every labelled language is learned; all
dictionaries together have at most `all_bytes`, so with very many languages each gets less. A text is
reduced to its lower-case letters, cut into blocks (so that a long text can't become its own dictionary) and every
block is compressed with every dictionary; all blocks count. Short texts ride on a piece of the dictionary, else a
block that doesn't shrink would be stored as it is. The margin to the second language gives the score, and a narrow one
is rejected (`accepted` false), the prediction being kept beside it. Equal sizes go to the language with more rows.

Defined results: a null text or one without letters (Unicode categories L*) is `und` with score 0; so is every text if nothing is labelled; a row
without doc_id is not held out and not learned from; repeated rows are predicted alike; extra columns pass through, one with the name of
a new column is replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, with_workers

SAMPLE_DOCS, DOC_BYTES, DICT_BYTES = 200, 1500, 100_000
#: All dictionaries together, as they are sent to the workers.
ALL_BYTES = 64_000_000
#: Languages that are learned at most: those with the most rows, ties by name.
LANGUAGES = 10_000
#: Rows that are drawn for each language on average, however many languages there are.
LEAST_DOCS = 8
BLOCK, SHORT, CARRIER = 2048, 300, 400
#: A prediction is accepted if the second size is larger by this share, and by MARGIN_BYTES.
MARGIN, MARGIN_BYTES = 0.01, 2
LEVEL, MIN_MATCH = 11, 3
UND = "und"



def _class(*kinds: str) -> str:
    """The characters whose Unicode category begins with one of `kinds`, as ranges of a character class."""
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


#: What is neither a letter nor a mark on one; and a letter.
_OTHER, _LETTER = re.compile(f"[^{_class('L', 'M')}]+"), re.compile(f"[{_class('L')}]")


def letters(text: str | None) -> bytes:
    """Lower-case words of letters, with a space around each; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {words} ".encode("utf-8", "replace") if words and _LETTER.search(words) else b""


class Classifier:
    """dictionaries: (language, content), the most frequent language first."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard as zstd

        self.langs, self.packers, self.carriers, self.bases = [], [], [], []
        for lang, content in dictionaries:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            p = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            packer = zstd.ZstdCompressor(dict_data=d, compression_params=p).compress
            self.langs.append(lang)
            self.packers.append(packer)
            self.carriers.append(content[:CARRIER])
            self.bases.append(len(packer(content[:CARRIER])))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        raw = letters(text)
        if not raw or not self.langs:
            return UND, 0.0, False
        if len(raw) < SHORT:
            sizes = [len(p(c + raw)) - b for p, c, b in zip(self.packers, self.carriers, self.bases)]
        else:
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = [sum(len(p(b)) for b in blocks) for p in self.packers]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        score = 1 / sum(2.0 ** -min(60, s - best) for s in sizes)
        gap = sizes[order[1]] - best if len(order) > 1 else BLOCK
        return self.langs[order[0]], score, gap >= max(MARGIN_BYTES, MARGIN * best)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, all_bytes: int = ALL_BYTES) -> list[tuple[str, bytes]]:
    """(language, content) from labelled(doc_id, lang, text), the most frequent language first.

    The driver gets a count for each of LANGUAGES languages and the beginnings of the rows that are drawn: about 2 * sample_docs a language, fewer where all languages'
    together would pass all_bytes. A row is drawn with that number by the rows of its language, and once however often it is repeated.
    """
    spark = labelled.sparkSession
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    most = max(256, min(DICT_BYTES, all_bytes // len(counts)))
    each = max(LEAST_DOCS, min(2 * sample_docs, all_bytes // (DOC_BYTES * len(counts))))
    rates = spark.createDataFrame([(lang, int(min(1.0, each / n) * (1 << 30))) for lang, n in counts.items()], "__lang string, __rate long")
    draw = F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"))
    drawn = labelled.join(F.broadcast(rates), F.col("lang") == F.col("__lang")).filter(F.pmod(draw, F.lit(1 << 30)) < F.col("__rate"))  # a row for each language
    cut = drawn.select("lang", draw.alias("draw"), F.substring("text", 1, DOC_BYTES).alias("text")).dropDuplicates()
    found: dict[str, list] = {}
    for r in cut.collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return [(lang, b"".join(letters(t)[:DOC_BYTES] for _, t in sorted(found[lang])[:each])[:most]) for lang in counts if lang in found]


def predicted(docs: DataFrame, classifier: list[tuple[str, bytes]], keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with lang_pred, score, accepted."""
    spark = docs.sparkSession
    with_workers(spark)
    keep = kept_columns(docs.columns if keep is None else keep, "lang_pred", "score", "accepted")
    sent = spark.sparkContext.broadcast([x for x in classifier if x[1]])

    def run(batches):
        c = Classifier(sent.value)
        for b in batches:
            got = [c.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), *new]))


def digest(docs: DataFrame) -> DataFrame:
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = dictionaries(taught.select("doc_id", "lang", "text"))
    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predicted(asked, known, keep=["doc_id", "held_out"])

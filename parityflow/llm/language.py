"""Language identification by compression.

Every language has a zstandard raw-content dictionary, cut from a bounded sample of labelled
texts. A text is compressed with each of them, block by block so that the dictionary counts
over the whole text (all in lower case), and the language that needs the fewest bytes wins. The score is the
share of bytes that it saves against the runner-up; a narrow margin rejects the text.

Null text, and text without a letter, is ``und`` with score 0 and rejected; so is every text
where nothing was learned. With one learned language the score is 1. Ties go to the language
first by code point. Repeated rows and empty tables need no care, as every text is judged
alone; other columns pass through unless they bear the name of an output column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_TEXTS = 96  #: labelled texts of a language that make its dictionary
SAMPLE_CHARS = 1_000  #: characters taken from each, at a place that its hash picks
BLOCK_BYTES = 1_024  #: a text is compressed in blocks of this size
LEVEL = 6  #: of compression
MARGIN = 0.002  #: a smaller score rejects the text
UNKNOWN = "und"


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language: at most ``SAMPLE_TEXTS * SAMPLE_CHARS`` characters each.

    The driver gets this sample only. Rows without text or label teach nothing.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.lower(F.col(text)).alias("text")).filter((F.length("text") > 0) & F.col("lang").isNotNull())
    mark = rows.withColumn("h", F.xxhash64("text", "lang"))
    # the rank limit is applied in every task before rows move, so a language with most of the rows is no burden
    first = mark.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= SAMPLE_TEXTS)
    at = F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    cut = first.select("lang", "r", F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
    parts: dict[str, list] = {}
    for row in cut.collect():
        parts.setdefault(row.lang, []).append((row.r, row.part))
    return {k: "\n".join(p for _, p in sorted(v)).encode() for k, v in sorted(parts.items())}


def _predictor(model: dict[str, bytes]) -> Callable[[str | None], tuple[str, float]]:
    names, tools = sorted(model), []
    for name in names:
        d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def predict(text: str | None) -> tuple[str, float]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(names) == 1:
            return names[0], 1.0
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum([len(compress(b)) for b in blocks]) for compress in tools]
        best, second = sorted(sizes)[:2]
        return names[sizes.index(best)], 1.0 - best / second

    return predict


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` (``und``, or a score under ``margin``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded per language, see fit

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        predict = _predictor(shared.value)
        return pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "score"])

    made = predicted(F.col(f"`{text}`"))
    names = {"lang_pred", "score", "rejected"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    found = docs.select(*kept, made.alias("__made"))
    rejected = (F.col("__made.lang_pred") == UNKNOWN) | (F.col("__made.score") < margin)
    return found.select(*kept, "__made.lang_pred", "__made.score", rejected.alias("rejected"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that teaches nothing: CRC-32 of the id as text leaves 1 when divided by 3; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))

"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of labelled text.  A text is
normalised (lower case, what isn't a letter becomes a space), cut into blocks, and every
block is compressed with each dictionary, the first one behind the dictionary's last bytes,
whose own size is taken off: alone a short text would be stored as it is, which tells nothing.
The language with the smallest sum is predicted (ties: the smaller name).  All blocks of a text
count, however long or short it is.  The margin is what the runner-up needs more, as a share of
its size; a text whose margin is below ``least_margin`` is rejected, and so is one without any
letter.

Every label is learned, and what is learned is bounded: of each label at most ``samples``
documents, those with a letter first and then by a hash of the id, with ``per_document``
characters each, up to ``dictionary`` bytes.  That is for up to 64 labels; more of them share
what 64 would get, so each has less.  Time grows with the labels, as every dictionary is tried.

Null texts and texts without a letter get ``und`` with score 0; so does everything if there
is nothing to learn from.  The score is 1 / (1 + 2 ** -n), n the bytes that the runner-up
needs more.  Rows that repeat are predicted alike; an empty table gives an empty result.
Columns of docs keep their names; the result's name gets underscores where it is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, fresh, released

#: FULL labels get SAMPLES, PER_DOCUMENT and DICTIONARY whole; more labels share them.
FULL, SAMPLES, PER_DOCUMENT, DICTIONARY = 64, 256, 1000, 1 << 16
#: Bytes of a block, zstandard's level, and bytes of the dictionary that a text stands behind.
BLOCK, LEVEL, PRIMER = 2048, 12, 256
LEAST_MARGIN = 0.005
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order: Column | None = None,
    languages: int | None = None,
    samples: int = SAMPLES,
    per_document: int = PER_DOCUMENT,
    dictionary: int = DICTIONARY,
) -> dict[str, bytes]:
    """A dictionary for each language, of a bounded sample of the labelled rows; ``languages``: only of so many, the most frequent."""
    read = labelled.filter(col(lang_col).isNotNull() & col(text_col).isNotNull())
    if languages is not None:
        common = read.groupBy(col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages)
        read = read.filter(col(lang_col).isin([r.lang for r in common.collect()]))
    labels = read.select(col(lang_col)).distinct().count()
    if labels > FULL:
        dictionary = max(1, dictionary * FULL // labels)
        documents = samples * FULL
        samples = max(1, documents // labels)
        per_document = min(per_document, max(1, per_document * documents // (samples * labels)))
    order = F.xxhash64(col(text_col)) if order is None else order
    slim = read.select(
        col(lang_col).alias("lang"), F.substring(col(text_col), 1, per_document).alias("text"), order.alias("order")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(~F.col("text").rlike(r"\p{L}"), "order", "text"))
    rows = slim.withColumn("place", place).filter(F.col("place") <= samples).orderBy("lang", "place").collect()
    found: dict[str, bytes] = {}
    for row in rows:
        found[row.lang] = (found.get(row.lang, b"") + normalised(row.text).encode() + b" ")[:dictionary]
    return {lang: data for lang, data in found.items() if data.strip()}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.known = []
        for lang in sorted(dictionaries):
            compressor, primer = _compressor(dictionaries[lang]), dictionaries[lang][-PRIMER:]
            self.known.append((lang, compressor.compress, primer, len(compressor.compress(primer))))

    def sizes(self, text: str) -> dict[str, int]:
        data = normalised(text).encode()
        blocks = [data[i : i + BLOCK] for i in range(BLOCK, len(data), BLOCK)]
        first = {lang: max(0, len(compress(primer + data[:BLOCK])) - own) for lang, compress, primer, own in self.known}
        return {lang: first[lang] + sum(len(compress(b)) for b in blocks) for lang, compress, _, _ in self.known}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if not self.known or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        ranked = sorted((n, lang) for lang, n in self.sizes(text).items())
        best, lang = ranked[0]
        if len(ranked) == 1:
            return lang, 1.0, 1.0
        more = ranked[1][0] - best
        return lang, 1 / (1 + 2.0 ** -min(more, 60)), more / max(1, ranked[1][0])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """docs with a struct ``language``: lang_pred, score, margin, accepted."""

    @released
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return told(batches)

    (name,) = fresh(docs, "language")
    found = docs.withColumn(name, predict(col(text_col)))
    accepted = (F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.margin") >= least_margin)
    return found.withColumn(name, F.col(name).withField("accepted", accepted))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; false for null ids, which aren't learned from either."""
    return F.coalesce(F.crc32(F.encode(col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn_from(docs: DataFrame, id_col: str = "doc_id", **options) -> dict[str, bytes]:
    """Dictionaries from the documents that aren't held out."""
    known = docs.filter(col(id_col).isNotNull() & ~held_out(id_col))
    return learn(known, order=F.xxhash64(col(id_col)), **options)

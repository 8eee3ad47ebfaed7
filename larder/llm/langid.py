"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import share_of, shuffle_key

#: Bound of the training sample: rows of a language, and bytes of each; a longer text teaches by one window of it.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 16384
#: Bytes of each language's dictionary, of the small ones for a second look, and bytes compressed at once.
DICTIONARY, SLICE, CHUNK = 160_000, 20_000, 4096
#: Under the first relative gap between the best two languages the small dictionaries decide; under the second the text is rejected.
SECOND_LOOK, MARGIN = 0.06, 0.002
UNDETERMINED = "und"
#: Bytes that stay, ASCII letters and all of UTF-8's longer sequences; the rest become spaces.
_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def learn_dictionaries(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw content for each language: texts of at most ``sample_rows`` rows, those of least hashed doc_id.

    ``docs`` has doc_id, text and lang of the rows to learn from; null lang or text is left
    out; of a text over ``sample_bytes`` a window of ``sample_bytes`` // 4 characters, which are no
    more bytes, teaches, its place chosen by a hash. The sample's size doesn't depend on the table's. Repeated rows
    teach as often as they are in the sample; other columns are not read; no rows give no dictionaries.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fit = slim.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # twice the share of rows that is wanted, so that what meets in one task does not grow with the table
    many = fit_counts(fit)
    fit = fit.join(F.broadcast(many), "lang").where(share_of(shuffle_key(5, F.col("doc_id"))) * F.col("rows") < 2 * sample_rows)
    window = sample_bytes // 4
    begin = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.char_length("text") - window, F.lit(0)) + 1).cast("int") + 1
    fit = fit.withColumn("text", F.when(F.octet_length("text") <= sample_bytes, F.col("text")).otherwise(F.substring("text", begin, F.lit(window))))
    order = Window.partitionBy("lang").orderBy(shuffle_key(5, F.col("doc_id")), "text")
    fit = fit.select("doc_id", "lang", "text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows)
    texts: dict[str, list[bytes]] = {}
    for row in fit.select("lang", "n", "text").sort("lang", "n").toArrow().to_pylist():
        texts.setdefault(row["lang"], []).append(b" ".join(words(row["text"])))
    return {lang: content[:size] for lang, found in texts.items() if (content := b" ".join(found).strip())}


def fit_counts(docs: DataFrame) -> DataFrame:
    """A row per language, however many documents."""
    return docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("rows"))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, object, list]]:
    """For each language a function that compresses with its whole dictionary, and finer, slower ones with its slices."""
    import zstandard as z

    def compressor(content: bytes, strategy: int, min_match: int, search_log: int):
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        how = z.ZstdCompressionParameters.from_level(
            3, source_size=CHUNK, dict_size=len(content), strategy=strategy, min_match=min_match, search_log=search_log, **plain
        )
        raw = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=how)
        return z.ZstdCompressor(dict_data=raw, compression_params=how).compress

    return [
        (lang, compressor(content, z.STRATEGY_LAZY, 4, 4), [compressor(content[k : k + SLICE], z.STRATEGY_BTOPT, 3, 5) for k in range(0, len(content), SLICE)])
        for lang, content in sorted(dictionaries.items())
    ]


def identify(
    text: str | None, by_language: list, margin: float = MARGIN, second_look: float = SECOND_LOOK, chunk: int = CHUNK
) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of a whole text.

    What is compressed is the whole text, lower-cased, its marks and digits as spaces, in pieces of
    ``chunk`` bytes, each alone, so that a long text cannot serve as its own dictionary. Sizes are summed
    over the pieces. Under a gap of ``second_look`` the slices of the dictionaries decide.
    """
    if not text or not by_language or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, True
    content = b" %b " % b" ".join(words(text))
    parts = [content[k : k + chunk] for k in range(0, len(content), chunk)]

    def ranking(use) -> tuple[list[tuple[int, str]], float]:
        ranked = sorted((sum(len(compress(part)) for compress in use(x) for part in parts), x[0]) for x in by_language)
        return ranked, (ranked[1][0] - ranked[0][0]) / ranked[1][0] if len(ranked) > 1 else 1.0

    ranked, gap = ranking(lambda x: [x[1]])
    if gap < second_look:
        ranked, gap = ranking(lambda x: x[2])
    best, lang = ranked[0]
    score = 1 / sum(math.exp(-min(50.0, 40.0 * (size - best) / best)) for size, _ in ranked)
    return lang, score, gap, gap < margin


def identify_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, second_look: float = SECOND_LOOK, chunk: int = CHUNK, keep: bool = False
) -> DataFrame:
    """The language of every whole text, by the smallest compressed size; ties go to the first by code point.

    Returns doc_id, lang_pred, score, margin (the relative gap to the second language) and
    rejected (``und``, or a gap under ``margin``). Null text and texts without a letter are
    ``und`` with score 0. With ``keep``: the rows of ``docs`` that are not rejected, with all
    columns and nothing else. The dictionaries, of a bounded size, go along with the task.
    """
    if keep:

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with_all = compressors(dictionaries)
            for batch in batches:
                texts = batch.column("text")
                yield batch.filter(pa.array([not identify(t.as_py(), with_all, margin, second_look, chunk)[3] for t in texts], pa.bool_()))

        return docs.mapInArrow(select, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_all = compressors(dictionaries)
        for batch in batches:
            found = [identify(t.as_py(), with_all, margin, second_look, chunk) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)

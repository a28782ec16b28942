"""The corpus pipeline: ``documents`` through five operators, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns each mixed document's encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe_codec import encode_documents
from millrace.llm.exact_dedup import drop_copies
from millrace.llm.language_id import drop_unknown
from millrace.llm.mixing import apply_mix
from millrace.llm.near_dedup import drop_near_copies
from millrace.llm.staging import discard, stage, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Null, empty and letterless texts go, with and without an id; long texts are read whole;
    rows of one text go or stay together, so ties and repeated rows need no rule; an empty
    table stays empty; other columns are kept, whatever their names.
    """
    return drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest doc_id, a null one only if no other is there.

    Null and empty texts are one text; texts are compared whole by digest; rows that repeat
    doc_id and text become one; an empty table stays empty; other columns are kept.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id, a null one only if no other is there.

    Null, empty and blank texts are one class, texts of fewer than five words one shingle,
    long texts are compared whole; of rows that repeat the smallest doc_id one stays; an
    empty table stays empty; other columns are kept.
    """
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them, at most three times, ties by doc_id and text.

    A null source is a source of its own; documents without words stay once; a document of a
    third of a source counts by its words like any other; rows that repeat doc_id, text and
    source are taken together; an empty table stays empty; other columns are kept.
    """
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and digests of each mixed document's tokens, one row for each row.

    A null text counts as empty and has no tokens; long texts are encoded whole; repeated
    rows are encoded each; an empty table gives an empty result; other columns are not read.
    """
    return encode_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: Classification, order MinHash and index permutations have no SQL form; the tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and reread as the next one's input.

    Tables that a stage works with are deleted when its result is written, and the result
    when the next one's is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *earlier, (_, last) = STAGES
    written: list[DataFrame] = []
    for name, step in earlier:
        with temporary(spark) as tables:
            docs = tables.keep(stage(step(spark, docs, sf_dir), name))
        discard(*written)
        written = [docs]
    return last(spark, docs, sf_dir)

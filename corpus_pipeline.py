"""Five stages that turn raw documents into packed training sequences.

Defined cases of all stages: other columns pass through whatever their names, and may be null; an empty table stays one;
repeated rows are worked on alike. Each stage's own cases stand with it; its operator's module has them in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavespan.llm.common import table
from wavespan.llm.linededup import line_dedup
from wavespan.llm.ngramjoin import keep_one
from wavespan.llm.packing import pack
from wavespan.llm.queries import WORD_BPE
from wavespan.llm.suffixdedup import remove_repeats
from wavespan.llm.toxicity import reject_toxic

#: Near-duplicate stages take five words and a similarity of 0.8.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null or empty text has the score of no feature; without labels of both classes, the share of toxic ones."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate of many sites. Null text stays null; a null source is a site; of a boilerplate line the first occurrence stays."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates. Texts without a word and rows without id stay; rows that share the id that stays do, too."""
    return keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes that occur earlier; whole characters go. Rows without id come after all others; a text that goes whole is left empty."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is its end token alone."""
    return pack(docs, WORD_BPE)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_join", near_duplicates), ("suffix_dedup", repeats), ("packing", packing)]
#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    from wavespan.llm.common import saved

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

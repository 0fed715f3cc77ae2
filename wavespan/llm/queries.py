"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, chat, langid, linededup, maxent, merkle, ngramjoin, packing, periodic, pieces, quality, suffixdedup, toxicity
from .common import table

#: Vocabulary files of the packing query and of the pieces query.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {
    "op1_additive_ann": lambda spark, d: ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0),
    "op2_sentencepiece": lambda spark, d: pieces.encode(table(spark, d, "documents"), PIECES),
    "op3_suffix_dedup": lambda spark, d: suffixdedup.suffix_dedup(table(spark, d, "documents")),
    "op4_maxent_lm": lambda spark, d: maxent.lm_scores(table(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_line_dedup": lambda spark, d: linededup.report(table(spark, d, "documents")),
    "op7_language_id": lambda spark, d: langid.language_id(table(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), WORD_BPE),
    "op9_ngram_join": lambda spark, d: ngramjoin.ngram_join(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality.quality_rules(table(spark, d, "documents")),
    "op11_chat_format": lambda spark, d: chat.report(table(spark, d, "conversations")),
    "op12_periodic_runs": lambda spark, d: periodic.report(table(spark, d, "documents"), periodic.planted),
    "op13_merkle_manifest": lambda spark, d: merkle.report(table(spark, d, "documents")),
}
SQL = {"op6_line_dedup": linededup.SQL, "op9_ngram_join": ngramjoin.SQL, "op10_quality_rules": quality.SQL, "op11_chat_format": chat.SQL, "op13_merkle_manifest": merkle.SQL}

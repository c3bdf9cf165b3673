"""The package's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.chat_formatting import OP1_SQL, op1_chat_formatting
from folioscope.llm.decontamination import OP7_SQL, op7_decontamination
from folioscope.llm.language_id import op9_language_id
from folioscope.llm.ngram_jaccard import OP8_SQL, op8_ngram_jaccard
from folioscope.llm.quality_rules import OP2_SQL, op2_quality_rules
from folioscope.llm.sentencepiece_fst import op6_sentencepiece
from folioscope.llm.sharding import op5_sharding
from folioscope.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from folioscope.llm.suffix_dedup import op4_suffix_dedup
from folioscope.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_quality_rules, op3_substring_dedup, op4_suffix_dedup, op5_sharding, op6_sentencepiece, op7_decontamination, op8_ngram_jaccard, op9_language_id, op10_toxicity)
}

#: Suffixes are another way to the same removals as windows. The others: crc32 (5), a vocabulary file (6) and trained
#: models (9, 10) are beyond SQL.
SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_suffix_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op8_ngram_jaccard": OP8_SQL}

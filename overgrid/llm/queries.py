"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from overgrid.llm import bpe, collocations, conversations, decontaminate, fingerprints, licenses, lines, near, pages, paragraphs, pii, quality, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_paragraphs": paragraphs.op4_paragraphs,
    "op5_warc": warc.op5_warc,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_near_dedup": near.op7_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_main_text": pages.op9_main_text,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_licenses": licenses.op12_licenses,
    "op13_conversations": conversations.op13_conversations,
    "pipeline": corpus_pipeline.run,
}
#: The whole of an operator whose query above is held to a part of it.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_passages": paragraphs.op4_passages}
ORACLES: dict[str, str] = {
    "op6_line_dedup": lines.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_licenses": licenses.ORACLE,
    "op13_conversations": conversations.ORACLE,
}

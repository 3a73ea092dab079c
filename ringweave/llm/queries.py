"""The queries of this subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

from . import decontaminate, language, lines, neardup, neighbours, packing, passages, quality, repeats, warc

QUERIES = {
    "op1_nearest_neighbours": neighbours.query,
    "op2_passage_dedup": passages.query,
    "op3_decontaminate": decontaminate.query,
    "op4_line_dedup": lines.query,
    "op5_warc": warc.query,
    "op6_packing": packing.query,
    "op7_quality": quality.query,
    "op8_near_duplicates": neardup.query,
    "op9_language": language.query,
    "op10_repeated_bytes": repeats.query,
}

ORACLES = {
    "op1_nearest_neighbours": neighbours.ORACLE,
    "op2_passage_dedup": passages.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_near_duplicates": neardup.ORACLE,
}

"""Queries of the training-data operators for the driver's entry file."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .fingerprints import op2_fingerprints
from .language_id import op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP1_SQL, op1_mixing
from .ngram_join import op5_ngram_join
from .token_output import op7_token_output
from .toxicity import op8_toxicity
from .url_filters import op3_url_filters
from .warc import op6_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_token_output": op7_token_output,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op9_line_dedup": OP9_SQL}

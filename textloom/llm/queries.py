"""The operators' queries, and their SQL where SQL can express them."""

from . import op2_decontamination, op3_substrings, op6_mixing, op9_lines
from .op1_toxicity import op1_toxicity
from .op4_quality import op4_quality
from .op5_simhash import op5_simhash
from .op7_tokens import op7_tokens
from .op8_language import op8_language
from .op10_token_ids import op10_token_ids

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination.op2_decontamination,
    "op3_substrings": op3_substrings.op3_substrings,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_tokens": op7_tokens,
    "op8_language": op8_language,
    "op9_lines": op9_lines.op9_lines,
    "op10_token_ids": op10_token_ids,
}
SQL = {
    "op2_decontamination": op2_decontamination.SQL,
    "op3_substrings": op3_substrings.SQL,
    "op6_mixing": op6_mixing.SQL,
    "op9_lines": op9_lines.SQL,
}

"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, chat, lines, mixing, quality, tokens, toxicity, urls
from .simhash import op5_simhash

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op10_toxicity": toxicity.op10_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_ann": ann.op3_ann,
    "op4_urls": urls.op4_urls,
    "op5_simhash": op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_chat": chat.op8_chat,
    "op9_tokens": tokens.op9_tokens,
}
ORACLES: dict[str, str] = {
    "op1_lines": lines.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op7_quality": quality.ORACLE,
    "op8_chat": chat.ORACLE,
}

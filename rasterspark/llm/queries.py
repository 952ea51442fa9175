"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, media, recompression, secrets, simhash, suffixes, templates, toxicity, wordpiece

QUERIES = {
    f.__name__: f
    for f in (
        recompression.op1_substring_dedup,
        secrets.op2_secret_scans,
        bpe.op3_bpe,
        wordpiece.op4_token_counts,
        toxicity.op5_toxicity,
        suffixes.op6_suffix_array_dedup,
        chat.op7_chat_formatting,
        templates.op8_benchmark_decontamination,
        media.op9_media_columns,
        simhash.op10_simhash,
    )
}
ORACLE_SQL = {"op7_chat_formatting": chat.OP7_SQL}

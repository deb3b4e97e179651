"""The subpackage's queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from shelfmatch.llm.chat_formatting import OP10_SQL, op10_chat_formatting
from shelfmatch.llm.decontamination import op9_decontamination
from shelfmatch.llm.language_id import op4_language_id
from shelfmatch.llm.line_dedup import op8_line_dedup
from shelfmatch.llm.lm_scoring import op3_lm_scoring
from shelfmatch.llm.media_copies import op7_media_copies
from shelfmatch.llm.secret_scan import op1_secret_scan
from shelfmatch.llm.sentencepiece_codec import op6_sentencepiece
from shelfmatch.llm.simhash_dedup import op2_simhash
from shelfmatch.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash": op2_simhash,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_media_copies": op7_media_copies,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
}

SQL = {"op5_warc": OP5_SQL, "op10_chat_formatting": OP10_SQL}

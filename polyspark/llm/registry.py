"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, ngram_jaccard, secret_scan
from .decontaminate import op6_decontaminate
from .embedding_dedup import op1_embedding_dedup
from .html_extract import op9_html_extract
from .language_id import op8_language_id
from .license_scan import op5_license_scan
from .line_dedup import op4_line_dedup
from .ngram_jaccard import op3_ngram_jaccard
from .piece_bpe import op7_sentencepiece
from .secret_scan import op10_secret_scan
from .suffix_dedup import op2_suffix_dedup

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_html_extract": op9_html_extract,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op3_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op10_secret_scan": secret_scan.ORACLE_SQL,
}

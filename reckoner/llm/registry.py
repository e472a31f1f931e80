"""Queries and SQL of this folder's operators."""

from __future__ import annotations

from . import exact, lines, phrases, urls, vq
from .ann import op9_nearest_neighbours
from .bpe import op2_byte_level_bpe
from .exact import op8_exact_dedup
from .html import op3_html_extraction
from .langid import op10_language_id
from .licences import op4_license_scan
from .lines import op7_line_dedup
from .lm import op5_lm_scoring
from .mixing import op1_mixing
from .phrases import op12_phrase_collocations
from .simhash import op6_simhash_near_dedup
from .urls import op13_url_filter
from .vq import op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_byte_level_bpe,
        op3_html_extraction,
        op4_license_scan,
        op5_lm_scoring,
        op6_simhash_near_dedup,
        op7_line_dedup,
        op8_exact_dedup,
        op9_nearest_neighbours,
        op10_language_id,
        op11_vector_codes,
        op12_phrase_collocations,
        op13_url_filter,
    )
}
ORACLE_SQL = {
    "op7_line_dedup": lines.ORACLE,
    "op8_exact_dedup": exact.ORACLE,
    "op11_vector_codes": vq.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_url_filter": urls.ORACLE,
}

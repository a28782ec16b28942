"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .ann_search import op1_ann_search
from .bpe_codec import op3_bpe
from .chat_format import OP9_SQL, op9_chat_format
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language_id import op10_language_id, op10_page_language
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import MIXING_SQL, mixing_targets, op5_mixing
from .near_dedup import op2_near_dedup
from .phrase_mining import OP12_SQL, op12_phrase_mining
from .pii_surrogates import op4_pii_surrogates
from .pu_quality import op13_pu_quality
from .secret_scan import SECRET_SQL, op7_secret_scan, secret_base_counts
from .substring_dedup import OP8_SQL, op8_substring_dedup

QUERIES = {
    "op1_ann_search": op1_ann_search,
    "op2_near_dedup": op2_near_dedup,
    "op3_bpe": op3_bpe,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op10_page_language": op10_page_language,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_pu_quality": op13_pu_quality,
    "mixing_targets": mixing_targets,
    "secret_base_counts": secret_base_counts,
}
SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_phrase_mining": OP12_SQL,
    "mixing_targets": MIXING_SQL,
    "secret_base_counts": SECRET_SQL,
}

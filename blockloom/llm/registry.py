"""The queries of the text operators, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import conversation_repair, decontamination, exact_dedup, jaccard_join, language_id, lexical_search, license_scan, packing, prefix_bpe, secret_scan, token_file, url_filter, warc_archive


def queries() -> dict[str, Callable]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_prefix_bpe": prefix_bpe.op12_prefix_bpe,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_warc_archive": warc_archive.op5_warc_archive,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_token_file": token_file.op7_token_file,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_license_scan": license_scan.op9_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op2_url_filter": url_filter.OP2_SQL,
        "op5_warc_archive": warc_archive.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
    }

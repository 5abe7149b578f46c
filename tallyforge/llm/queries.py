"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tallyforge.llm import ann, bpe, extract, jaccard, langid, mixing, quality, sharding, urlrules, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1,
        "op2_language_id": langid.op2,
        "op3_html_extraction": extract.op3,
        "op4_jaccard_join": jaccard.op4,
        "op5_warc_derivatives": warc.op5,
        "op6_mixing": mixing.op6,
        "op7_byte_bpe": bpe.op7,
        "op8_nearest_neighbours": ann.op8,
        "op9_url_filters": urlrules.op9,
        "op10_sharding": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": jaccard.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op8_nearest_neighbours": ann.OP8_SQL}

"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import audio, lang_id, line_dedup, mixing, near_dup, packing, pii, quality, sentencepiece_codec, url_filter


def queries():
    return {
        "op1_pack": packing.op1_pack,
        "op2_near_dup": near_dup.op2_near_dup,
        "op3_mix": mixing.op3_mix,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_lang_id": lang_id.op5_lang_id,
        "op6_quality": quality.op6_quality,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_pii": pii.op8_pii,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_audio": audio.op10_audio,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    found = {"op3_mix": mixing.OP3_SQL, "op6_quality": quality.OP6_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from . import decontaminate, embeddings, katz, langid, linededup, mixing, secrets, simhash, tokenstore, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_index(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return linededup.digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op5_katz_score(spark, sf_dir):
    return katz.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    return tokenstore.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [op1_warc_index, op2_mix_sources, op3_line_dedup, op4_language_id, op5_katz_score, op6_decontaminate, op7_simhash_near_dedup, op8_token_files, op9_embedding_near_dedup, op10_secret_scan]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": warc.oracle(), "op3_line_dedup": linededup.oracle(), "op6_decontaminate": decontaminate.oracle(), "op9_embedding_near_dedup": embeddings.oracle(), "op10_secret_scan": secrets.oracle()}

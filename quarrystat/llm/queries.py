"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystat.llm import (
    chat,
    collocations,
    decontaminate,
    jaccard_join,
    language_id,
    license_scan,
    lm_score,
    mixing,
    personal_data,
    quality_rules,
    secrets,
    token_align,
    token_output,
)
from quarrystat.llm.oracle import SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_config(**more: int) -> token_output.Output:
    return token_output.Output(tokenizer_path(), **more)


def align_config(**more: int) -> token_align.Align:
    import public_tokenizers

    return token_align.Align(tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"), **more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _read(s, d, "documents")
    return {
        "op1_language_id": lambda s, d: language_id.digest(docs(s, d)),
        "op2_lm_score": lambda s, d: lm_score.digest(docs(s, d)),
        "op3_mixing": lambda s, d: mixing.digest(docs(s, d)),
        "op4_quality_rules": lambda s, d: quality_rules.digest(docs(s, d)),
        "op5_token_output": lambda s, d: token_output.digest(docs(s, d), token_config()),
        "op6_chat": lambda s, d: chat.digest(_read(s, d, "conversations")),
        "op7_jaccard_join": lambda s, d: jaccard_join.digest(docs(s, d)),
        "op8_decontaminate": lambda s, d: decontaminate.digest(docs(s, d), _read(s, d, "benchmark")),
        "op9_secrets": lambda s, d: secrets.digest(docs(s, d)),
        "op10_license_scan": lambda s, d: license_scan.digest(docs(s, d)),
        "op11_token_alignment": lambda s, d: token_align.digest(docs(s, d), align_config()),
        "op12_collocations": lambda s, d: collocations.digest(docs(s, d)),
        "op13_personal_data": lambda s, d: personal_data.digest(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

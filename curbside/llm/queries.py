"""The queries of the subpackage by name, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbside.llm import (
    chat, collocations, decontaminate, langid, packing, pages, privacy, quality, secrets, shingle_join, token_files, vectors, whitening,
)
from curbside.llm.tables import ship


def _run(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(ship(spark), sf_dir)


QUERIES = {
    query.__name__: functools.partial(_run, query)
    for query in (
        shingle_join.op1_ngram_join,
        chat.op2_role_repair,
        privacy.op3_weak_supervision,
        packing.op4_best_fit_packing,
        token_files.op5_token_files,
        langid.op6_byte_cnn,
        secrets.op7_secrets,
        pages.op8_host_suffix_array,
        decontaminate.op9_simhash_windows,
        vectors.op10_multi_index,
        quality.op11_additive_quality,
        collocations.op12_collocations,
        whitening.op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op12_collocations": collocations.ORACLE,
    "op1_ngram_join": shingle_join.ORACLE,
    "op9_simhash_windows": decontaminate.ORACLE,
}

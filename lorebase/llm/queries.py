"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, exact, katz, lines, mixing, packing, passages, quality, secrets, simhash, spelling, turns, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_simhash": simhash.op2_simhash,
        "op3_secrets": secrets.op3_secrets,
        "op4_lines": lines.op4_lines,
        "op5_packing": packing.op5_packing,
        "op6_passages": passages.op6_passages,
        "op7_warc": warc.op7_warc,
        "op8_quality": quality.op8_quality,
        "op9_embeddings": embeddings.op9_embeddings,
        "op10_katz": katz.op10_katz,
        "op11_turns": turns.op11_turns,
        "op12_exact": exact.op12_exact,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.OP1_SQL, "op7_warc": warc.OP7_SQL, "op8_quality": quality.OP8_SQL, "op9_embeddings": embeddings.OP9_SQL, "op12_exact": exact.OP12_SQL, "op13_spelling": spelling.OP13_SQL}

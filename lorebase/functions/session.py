"""§2.16: the library's functions on a session, for use in SQL. Table functions stand
in FROM, with LATERAL where they read a column; they are SQL themselves and so are
planned with the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx

FUNCTIONS = {
    "lore_tokens(text STRING)": rf"""RETURNS TABLE (place INT, term STRING) RETURN
        SELECT p + 1, t FROM (SELECT posexplode(regexp_extract_all(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), r'[\p{{L}}\p{{N}}]+', 0)) AS (p, t))""",
    "lore_wikilinks(text STRING)": r"""RETURNS TABLE (place INT, target STRING, section STRING, label STRING) RETURN
        SELECT p + 1, trim(regexp_extract(m, r'^\[\[([^\]|#]+)', 1)), nullif(regexp_extract(m, r'#([^\]|]+)', 1), ''), nullif(regexp_extract(m, r'\|([^\]]+)\]', 1), '')
        FROM (SELECT posexplode(regexp_extract_all(text, r'\[\[[^\]|#]+(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 0)) AS (p, m))""",
    "lore_chunks(text STRING, words INT, overlap INT)": r"""RETURNS TABLE (place INT, chunk STRING) RETURN
        SELECT p + 1, array_join(slice(w, p * (words - overlap) + 1, words), ' ')
        FROM (SELECT w, explode(sequence(0, greatest(0, cast(ceil((size(w) - overlap) / (words - overlap)) AS INT) - 1))) AS p
              FROM (SELECT regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0) AS w) WHERE size(w) > 0)""",
    "lore_slug(title STRING)": r"""RETURNS STRING RETURN
        substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), r'[^\p{L}\p{N}_\s-]', ''), r'[\s_]+', '-'), r'-+', '-'), r'^-+|-+$', ''), 1, 80)""",
}


def register(spark: SparkSession) -> list[str]:
    """Makes ``lore_tokens``, ``lore_wikilinks``, ``lore_chunks`` and ``lore_slug``
    known to the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    return [head.split("(")[0] for head in FUNCTIONS]

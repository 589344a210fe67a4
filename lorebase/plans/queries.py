"""The registered queries: each operator bound to the test tables, with its SQL.

Roles of the tables: documents are sources and retrieval units, pages are web
pages, parts are entities, line items are source-entity edges (an order is the
source), orders are wiki pages, events are job events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import documents as dc, session, settings, text as tx
from ..operators import ask, checks, compile as pages_, graph, ingest, normalize, resolve, search
from ..operators.index import Index
from ..operators.shared import file_states, new_folder, written
from ..sources import article, bookmarks, files, vault
from ..streaming import jobs, lifecycle
from .engine import KnowledgeEngine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- roles -----------------------------------------------------------------


def units(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("source_id"), F.col("doc_id").alias("page_id"), F.lit("").alias("title"), F.col("text").alias("body"), F.col("lang").alias("unit_type"))


def trust(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    level = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "high").otherwise("medium")).when(F.col("quality") == 0, "low").otherwise("unknown")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), level.alias("trust_level"))


def parts(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    alias = F.array(F.concat_ws(" ", "p_brand", "p_size"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("canonical_name"), F.col("p_name").alias("display_name"),
        alias.alias("aliases"), F.lit(None).cast("string").alias("description"), (F.col("p_size") / 50.0).alias("confidence"), F.lit(None).cast("bigint").alias("created_from_source_id"),
    )


def named_parts(spark, d) -> DataFrame:
    """The entities without aliases, which stand for size and brand and join nearly all."""
    return parts(spark, d).withColumn("aliases", F.array().cast("array<string>"))


def lot_parts(spark, d) -> DataFrame:
    """Parts named with their brand, with aliases for brand and for size among parts of
    near numbers: names, brands and sizes join in chains."""
    p = table(spark, d, "part")
    name, k = F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey")
    aliases = F.array(F.concat_ws(" ", "p_brand", F.lit("batch"), F.floor(k / 40)), F.concat_ws(" ", F.lit("size"), "p_size", F.lit("of"), F.floor(k / 100)))
    return p.select(k.alias("id"), F.col("p_type").alias("entity_type"), name.alias("canonical_name"), name.alias("display_name"), aliases.alias("aliases"), (F.col("p_size") / 50.0).alias("confidence"))


def item_edges(spark, d) -> DataFrame:
    """Orders (sources) mention parts (entities)."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("source").alias("from_kind"), F.col("l_orderkey").alias("from_id"), F.lit("mentions").alias("relation_type"),
        F.lit("entity").alias("to_kind"), F.col("l_partkey").alias("to_id"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("evidence_source_id"),
    )


def part_edges(spark, d) -> DataFrame:
    """Each line's part is related to the part of the order's next line."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_id"))
    nxt = nxt.groupBy("l_orderkey", "l_linenumber").agg(F.min("to_id").alias("to_id"))
    j = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("from_id"), F.min("l_discount").alias("x")).join(nxt, ["l_orderkey", "l_linenumber"])
    kind = F.when(F.col("l_linenumber") % 2 == 0, "uses").otherwise("related_to")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("entity").alias("from_kind"), "from_id", kind.alias("relation_type"), F.lit("entity").alias("to_kind"), "to_id",
        (1 - F.col("x")).alias("confidence"), F.col("l_orderkey").alias("evidence_source_id"),
    )


PART_EDGES = """e AS (
  SELECT a.k * 10 + a.n AS id, a.p AS from_id, b.p AS to_id, CASE WHEN a.n % 2 = 0 THEN 'uses' ELSE 'related_to' END AS relation_type, 1 - a.x AS confidence, a.k AS evidence_source_id
  FROM (SELECT l_orderkey k, l_linenumber n, min(l_partkey) p, min(l_discount) x FROM lineitem GROUP BY 1, 2) a
  JOIN (SELECT l_orderkey k, l_linenumber - 1 n, min(l_partkey) p FROM lineitem GROUP BY 1, 2) b ON a.k = b.k AND a.n = b.n
)"""


def wiki(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("page_type"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active").alias("status"), F.col("o_orderdate").alias("updated_at"),
    )


# --- scalar functions ------------------------------------------------------

KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[-_/\\.]', ' ', 'g'), '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
SLUG = r"substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"
FOLD = f"translate(lower({{0}}), '{tx.ACCENTED}', '{tx.PLAIN}')"
WORDS = f"regexp_extract_all({FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


@query(f"SELECT p_partkey, {KEY.format('p_name')} AS name_key, {KEY.format('p_brand')} AS brand_key FROM part")
def txt_normalize_key(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.name_key(F.col("p_name")).alias("name_key"), tx.name_key(F.col("p_brand")).alias("brand_key"))


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def txt_slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS BIGINT) AS token_count, substr(text, 1, 500) AS excerpt FROM documents")
def txt_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).alias("token_count"), F.substring("text", 1, 500).alias("excerpt"))


STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+-]+')) AS tok, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+-]+')))) AS i FROM documents),
p AS (
  SELECT doc_id, i, 0 AS j, tok AS term FROM t
  UNION ALL SELECT doc_id, i, j + 1, part FROM (SELECT doc_id, i, unnest(regexp_split_to_array(tok, '[-+]')) AS part, unnest(range(len(regexp_split_to_array(tok, '[-+]')))) AS j FROM t WHERE regexp_matches(tok, '[-+]')) WHERE part <> ''
), f AS (SELECT doc_id, term, min(i * 1000 + j) AS pos FROM p WHERE term NOT IN ({STOP}) AND NOT regexp_full_match(term, '[0-9]+') AND length(term) > 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f)
SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY k), '') AS terms FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k <= 16 GROUP BY d.doc_id
""")
def txt_topical_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_join(tx.topical_terms(F.col("text")), " "), F.lit("")).alias("terms"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \-•]+|[ \-•]+$', '', 'g')), lambda x: length(x) >= 35)[1:4] AS l FROM c)
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN '' WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: rtrim(substr(x, 1, 240))), ' / ') ELSE rtrim(substr(t, 1, 240)) END AS claims FROM s
""")
def txt_key_claims(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.key_claims(F.col("text")), " / ").alias("claims"))


# The rules over lines: the lines of a text told, then its title and abstract.
LINES = r"""l AS (
  SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(replace(replace(coalesce(text, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '(?s)\A---\s*\n.*?\n---\s*\n?', ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT starts_with(x, '## Page ')), lambda x: struct_pack(line := x,
    meta := regexp_matches(x, '[@{}]') OR (regexp_matches(lower(x), '(?:^|[^\p{L}\p{N}_])(?:AFF)(?:[^\p{L}\p{N}_]|$)') AND len(string_split(x, ' ')) <= 8) OR regexp_matches(lower(x), '^(?:HDR)\s*:')
      OR (len(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*')) >= 4 AND len(list_filter(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*'), lambda w: lower(w) IN (CON))) = 0
        AND 5 * len(list_filter(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*'), lambda w: regexp_matches(w, '^[A-Z]'))) >= 4 * len(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*'))
        AND 10 * len(list_filter(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*'), lambda w: length(w) <= 12)) >= 9 * len(regexp_extract_all(x, '[A-Za-z][A-Za-z.''-]*'))),
    head := regexp_matches(x, '^\d+(?:\.\d+)*\s+[A-Z]') OR lower(x) IN (HEAD), mark := starts_with(lower(x), 'arxiv:'))) AS ls FROM documents
), u AS (
  SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM l
), st AS (
  SELECT doc_id, coalesce(min(i) FILTER (x.head OR x.mark), 21) AS stop FROM u WHERE i <= 20 GROUP BY doc_id
), bg AS (
  SELECT u.doc_id, stop, min(i) AS b FROM u JOIN st USING (doc_id) WHERE i <= 20 AND i < stop AND NOT x.meta GROUP BY ALL
), ed AS (
  SELECT bg.doc_id, b, least(stop, 21, coalesce(min(i) FILTER (x.meta AND i > b), 21)) AS e FROM bg JOIN u USING (doc_id) GROUP BY bg.doc_id, b, stop
), ow AS (
  SELECT doc_id, list_transform(ls[b:least(e - 1, b + 2)], lambda s: s.line) AS o FROM ed JOIN l USING (doc_id)
), tj AS (
  SELECT doc_id, CASE WHEN length(array_to_string(o[1:1], ' ')) >= 120 THEN array_to_string(o[1:1], ' ') WHEN length(array_to_string(o[1:2], ' ')) >= 120 THEN array_to_string(o[1:2], ' ') ELSE array_to_string(o, ' ') END AS t FROM ow
), ti AS (
  SELECT doc_id, substr(t, 1, 200) AS t FROM tj WHERE t <> '' AND NOT starts_with(lower(t), 'src_') AND NOT ends_with(lower(t), '.pdf') AND NOT regexp_full_match(lower(t), '\d{4}\.\d{5}(v\d+)?(_\d+)?')
), tt AS (
  SELECT doc_id, t AS inferred, coalesce(t, 'Untitled Source') AS title FROM documents LEFT JOIN ti USING (doc_id)
), ab AS (
  SELECT doc_id, min(i) AS a FROM u WHERE lower(x.line) = 'abstract' GROUP BY doc_id
), af AS (
  SELECT doc_id, i, x, coalesce(sum(length(x.line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM u JOIN ab USING (doc_id) WHERE i > a AND NOT x.mark
), sc AS (
  SELECT af.doc_id, substr(string_agg(x.line, ' ' ORDER BY i) FILTER (i < coalesce(h, 1000000)), 1, 800) AS s FROM af LEFT JOIN (SELECT doc_id, min(i) AS h FROM af WHERE x.head AND before >= 120 GROUP BY doc_id) USING (doc_id) GROUP BY af.doc_id
), op AS (
  SELECT doc_id, substr(string_agg(x.line, ' ' ORDER BY i) FILTER (i >= f), 1, 800) AS s FROM (SELECT doc_id, i, x, min(i) FILTER (length(x.line) >= 40 AND NOT x.meta AND NOT x.head) OVER (PARTITION BY doc_id) AS f FROM u JOIN tt USING (doc_id) WHERE x.line IS DISTINCT FROM inferred) GROUP BY doc_id
), d AS (
  SELECT tt.doc_id, title, coalesce(nullif(sc.s, ''), op.s, '') AS abstract FROM tt LEFT JOIN sc USING (doc_id) LEFT JOIN op USING (doc_id)
)"""
for _k, _v in (("AFF", "|".join(dc.AFFILIATIONS)), ("HDR", "|".join(dc.HEADERS)), ("CON", ", ".join(f"'{w}'" for w in dc.CONNECTORS)), ("HEAD", ", ".join(f"'{w}'" for w in dc.HEADINGS))):
    LINES = LINES.replace(f"({_k})", f"({_v})").replace(f"(?:{_k})", f"(?:{_v})")


def untitled(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), "text")


@query(f"WITH {LINES} SELECT doc_id, title FROM d")
def txt_title_infer(spark, d):
    return dc.described(untitled(spark, d)).select("doc_id", "title")


@query(f"WITH {LINES} SELECT doc_id, abstract FROM d")
def txt_abstract(spark, d):
    return dc.described(untitled(spark, d)).select("doc_id", "abstract")


@query()
def txt_key_concepts(spark, d):
    """Of each text's title and abstract; SQL's patterns have no edges of words in all scripts."""
    t = dc.with_concepts(dc.described(untitled(spark, d)))
    return t.select("doc_id", F.array_join("concepts", " / ").alias("concepts"))


@query(r"""
WITH m AS (SELECT p_partkey, 'See [[' || p_name || '|it]], [[' || p_brand || '#size]] and [[ ' || p_type || ' ]].' AS md FROM part)
SELECT p_partkey, array_to_string(list_sort(list_transform(regexp_extract_all(md, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: lower(trim(x)))), ' / ') AS links FROM m
""")
def txt_wikilinks(spark, d):
    md = F.concat(F.lit("See [["), "p_name", F.lit("|it]], [["), "p_brand", F.lit("#size]] and [[ "), "p_type", F.lit(" ]]."))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.wikilinks(md)), " / ").alias("links"))


@query("SELECT p_partkey, round(('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE - 0.5, 6) AS noise FROM part")
def txt_stable_noise(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(tx.stable_noise(F.col("p_partkey").cast("string")), 6).alias("noise"))


@query(r"SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000)) AS clamped, round(c_custkey * 3e-6 + c_nationkey * 15e-6, 9) AS cost, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM customer")
def txt_numbers_and_names(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", tx.clamp(F.col("c_acctbal") / 5000).alias("clamped"), F.round(tx.cost(F.col("c_custkey"), F.col("c_nationkey")), 9).alias("cost"), tx.safe_file_name(F.col("c_name")).alias("file_name"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: length(w) > 3), lambda w: regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g'))[1:5], ' ') AS terms,
       regexp_replace(substr(text, 1, 80), '[.? ]+$', '') AS title FROM conversations
""")
def ask_plan(spark, d):
    """QRY-01: the terms and title of every turn taken as a question."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"), tx.answer_title(F.col("text")).alias("title"))


# --- sources and ingest ----------------------------------------------------


@query("SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) AS title FROM pages")
def src_html_title(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 50000) AS text FROM pages")
def src_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query()
def src_article(spark, d):
    """SRC-07: the article of each page, without what stands around it."""
    return article.articles(table(spark, d, "pages"))


@query(f"""
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) WHERE length(term) > 9 GROUP BY 1, 2
""")
def sql_tokens(spark, d):
    """§2.16: long words per document, by a table function in SQL."""
    session.register(spark)
    return spark.sql("SELECT doc_id, term, count(*) AS n FROM {docs}, LATERAL lore_tokens(text) WHERE length(term) > 9 GROUP BY doc_id, term", docs=table(spark, d, "documents"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 20) / 180.0) AS BIGINT)))) AS p FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(p + 1 AS INTEGER) AS place, md5(array_to_string(w[p * 180 + 1:p * 180 + 200], ' ')) AS chunk_md5 FROM p
""")
def sql_chunks(spark, d):
    """§2.16: texts in chunks of 200 words that overlap by 20, by a table function in SQL."""
    session.register(spark)
    return spark.sql("SELECT doc_id, place, md5(chunk) AS chunk_md5 FROM {docs}, LATERAL lore_chunks(text, 200, 20)", docs=table(spark, d, "documents"))


DOMAIN = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][^:/?#]*://([^/?#]*)', 1)), '^www\.', '')"


@query(f"SELECT page_id, {DOMAIN.format('url')} AS domain, ends_with({DOMAIN.format('url')}, 'example.org') OR contains(lower(html[1:40]), 'lang=\"fr') AS trusted FROM pages")
def src_domain_trust(spark, d):
    domain = tx.url_domain(F.col("url"))
    return table(spark, d, "pages").select("page_id", domain.alias("domain"), tx.trusted(domain, F.substring("html", 1, 40), ["example.org"], ['lang="fr']).alias("trusted"))


@query(f"""
WITH b AS (SELECT page_id AS ordinal, url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS k FROM b WHERE url IS NOT NULL AND trim(url) <> '' AND lower(url) NOT LIKE 'javascript:%')
SELECT sha256(url) AS id, url, ordinal, CASE WHEN ends_with({DOMAIN.format('url')}, 'example.org') THEN 'approved' ELSE 'needs_review' END AS ingest_state FROM r WHERE k = 1
""")
def ing_url_dedup(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), "url")
    b = p.unionByName(p.withColumn("ordinal", F.col("ordinal") + 1000000)).withColumns({"title": F.col("url"), "folder_path": F.lit(""), "added_at": F.lit(None).cast("timestamp"), "domain": tx.url_domain(F.col("url"))})
    return ingest.source_rows(b, ["example.org"], []).select("id", "url", "ordinal", "ingest_state")


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS checksum FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY doc_id) AS k FROM d WHERE doc_id % 5 <> 0)
SELECT doc_id, checksum FROM r WHERE k = 1 AND checksum NOT IN (SELECT checksum FROM d WHERE doc_id % 5 = 0)
""")
def ing_checksum_dedup(spark, d):
    """Documents whose id ends in 0 or 5 are those already stored, the rest the batch."""
    t = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("checksum"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("deleted_at"))
    stored = F.col("doc_id") % 5 == 0
    return ingest.dedup_insert(t.where(~stored), t.where(stored)).select("doc_id", "checksum")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.summary'), '') AS summary FROM events")
def ing_json_path(spark, d):
    return table(spark, d, "events").select("event_id", tx.json_text(F.col("props"), "$.k").alias("k"), tx.json_text(F.col("props"), "$.summary", "").alias("summary"))


@query("""
SELECT d.doc_id, d.lang, d.source, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' WHEN quality = 0 THEN 'low' ELSE 'unknown' END AS trust_level
FROM documents d LEFT JOIN labels USING (doc_id) WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 200
""")
def ing_source_list(spark, d):
    """FLT-01: the newest 200 sources of one status."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("status"), "source", F.col("doc_id").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    found = KnowledgeEngine(spark, {"sources": t}).sources_list(status="en")
    return found.join(trust(spark, d), "id").select(F.col("id").alias("doc_id"), F.col("status").alias("lang"), "source", "trust_level")


@query("""
WITH c AS (SELECT conv_id, turn, trim(text, chr(32) || chr(10) || chr(13) || chr(9)) AS t, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, substr(t, 1, 200) AS name, 'concept' AS entity_type, greatest(0.0, least(1.0, n / 400.0))::DOUBLE AS confidence,
       CASE WHEN n <= 400 THEN t END AS claim, substr(t, 1, 800) AS summary FROM c WHERE t <> ''
""")
def nrm_validate(spark, d):
    """NRM-02 over conversation turns, each given as a raw normalised document."""
    c = table(spark, d, "conversations")
    raw = c.select(
        "conv_id", "turn", F.trim("text", F.lit(" \n\r\t")).alias("summary"),
        F.array(F.struct(F.col("text").alias("name"), F.col("role").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), (F.length("text") / 400.0).cast("double").alias("confidence"))).alias("entities"),
        F.array(F.struct(F.col("text").alias("text"), F.lit("fact").alias("claim_kind"), F.lit(2.0).alias("confidence"))).alias("claims"),
        F.array().cast("array<struct<from_name:string,relation_type:string,to_name:string,confidence:double>>").alias("relations"), F.array().cast("array<string>").alias("topic_labels"), F.array().cast("array<string>").alias("quality_flags"),
    )
    n = normalize.clean(raw)
    e = F.get("entities", F.lit(0))
    return n.select("conv_id", "turn", e["name"].alias("name"), e["entity_type"].alias("entity_type"), e["confidence"].alias("confidence"), F.get("claims", F.lit(0))["text"].alias("claim"), "summary")


@query()
def nrm_extract(spark, d):
    """NRM-01 over all documents."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), "text")
    n = normalize.extract(s)
    return n.select(F.col("source_id").alias("doc_id"), "title", "summary", F.size("entities").alias("n_entities"), F.size("claims").alias("n_claims"), F.array_join("quality_flags", ",").alias("flags"))


LINES_AS_DOCUMENTS = """l AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount DESC) - 1 AS n, l_partkey, l_discount, l_linenumber FROM lineitem),
m AS (SELECT s, n, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name || '.' END AS name, p_type AS entity_type, p_brand, p_size / 50.0 AS c, 1 - l_discount AS w FROM l JOIN part ON p_partkey = l_partkey),
x AS (SELECT entity_type, replace(lower(name), '.', '') AS k, sha256(entity_type || chr(1) || replace(lower(name), '.', '')) AS id, arg_min(name, s * 1000 + n) AS name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases, max(c) AS confidence, min(s) AS first_source FROM m GROUP BY ALL)"""


def _order_documents(spark, d) -> DataFrame:
    """Orders as normalised documents: their lines' parts are entities, each related to the next."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_type").alias("entity_type"), F.array("p_brand").alias("aliases"), (F.col("p_size") / 50.0).alias("confidence"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(p, "l_partkey")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(".")))
    line = F.struct("l_linenumber", "l_partkey", name.alias("name"), "entity_type", "aliases", "confidence", (1 - F.col("l_discount")).alias("w"))
    o = li.groupBy(F.col("l_orderkey").alias("source_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    tied = F.transform(F.slice("l", 1, F.size("l") - 1), lambda x, i: F.struct(x["name"].alias("from_name"), F.lit("sold_with").alias("relation_type"), F.get(F.col("l"), i + 1)["name"].alias("to_name"), x["w"].alias("confidence")))
    entities = F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["entity_type"].alias("entity_type"), x["aliases"].alias("aliases"), x["confidence"].alias("confidence")))
    claims = F.transform("l", lambda x: F.struct(F.concat(x["name"], F.lit(" was sold.")).alias("text"), F.lit("fact").alias("claim_kind"), x["w"].alias("confidence")))
    labels = F.array().cast("array<string>")
    return o.select("source_id", F.concat(F.lit("Order "), "source_id").alias("summary"), entities.alias("entities"), claims.alias("claims"), tied.alias("relations"), labels.alias("topic_labels"), labels.alias("quality_flags"))


@query(f"WITH {LINES_AS_DOCUMENTS} SELECT id, entity_type, name, aliases, confidence, first_source FROM x")
def nrm_entities(spark, d):
    """NRM-03: one entity per type and name key over all documents."""
    e = normalize.tables(_order_documents(spark, d))["entities"]
    return e.select("id", "entity_type", F.col("canonical_name").alias("name"), F.array_join("aliases", ",").alias("aliases"), "confidence", F.col("created_from_source_id").alias("first_source"))


@query(f"WITH {LINES_AS_DOCUMENTS} SELECT sha256(s || chr(1) || n || chr(1) || name || ' was sold.') AS id, s AS source_id, name || ' was sold.' AS claim_text, w AS confidence FROM m")
def nrm_claims(spark, d):
    """NRM-03: claims with identifiers that reruns repeat."""
    return normalize.tables(_order_documents(spark, d))["claims"].select("id", "source_id", "claim_text", "confidence")


@query(f"""
WITH {LINES_AS_DOCUMENTS}, i AS (SELECT lower(name) AS k, min(id) AS id FROM x GROUP BY 1), r AS (SELECT a.s, lower(a.name) AS f, lower(b.name) AS t, a.w FROM m a JOIN m b ON a.s = b.s AND b.n = a.n + 1)
SELECT f.id AS from_id, 'sold_with' AS relation_type, t.id AS to_id, max(w) AS confidence, min(s) AS evidence_source_id FROM r JOIN i f ON f.k = r.f JOIN i t ON t.k = r.t WHERE f.id <> t.id GROUP BY ALL
""")
def nrm_relations(spark, d):
    """NRM-03, JOI-17: relations between names, resolved to entities and merged."""
    return normalize.tables(_order_documents(spark, d))["relations"].select("from_id", "relation_type", "to_id", "confidence", "evidence_source_id")


@query("""
WITH l AS (SELECT o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_discount DESC) - 1 AS n, p_name, p_brand, p_type, 1 - l_discount AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT s AS source_id, string_agg(p_name || '/' || CASE WHEN n % 2 = 0 THEN 'tool' ELSE 'concept' END || '/' || p_brand || ' 1,' || p_brand || ' 2,' || p_brand || ' 3,' || p_brand || ' 4,' || p_brand || ' 5', ';' ORDER BY n) FILTER (n < 15) AS entities,
       string_agg(CASE WHEN n % 3 > 0 THEN p_name || ' sold/' || CASE WHEN n % 2 = 0 THEN 'definition' ELSE 'fact' END END, ';' ORDER BY n) FILTER (n < 15) AS claims,
       coalesce(string_agg(p_name || '>' || p_type || '/' || substr(repeat('related ', 8), 1, 50), ';' ORDER BY n) FILTER (n < 10), '') AS relations, string_agg(p_name, ';' ORDER BY n) FILTER (n < 6) AS labels, string_agg(p_type, ';' ORDER BY n) FILTER (n < 4) AS flags
FROM l GROUP BY s
""")
def nrm_limits(spark, d):
    """NRM-02, SRT-08: customers as documents of all their lines, beyond every limit; blank
    names, claims that are too long and kinds that are not known among them."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_id"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(o, "l_orderkey").join(p, "l_partkey")
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_discount")).alias("w"), "p_name", "p_brand", "p_type")
    c = li.groupBy("source_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    seven = F.sequence(F.lit(1), F.lit(7))

    def entity(x, i, name):
        return F.struct(name.alias("name"), F.when(i % 2 == 0, "tool").otherwise("strange").alias("entity_type"), F.transform(seven, lambda k: F.concat_ws(" ", x["p_brand"], k)).alias("aliases"), F.lit(2.0).alias("confidence"))

    entities = F.flatten(F.transform("l", lambda x, i: F.array(entity(x, i, F.lit("  ")), entity(x, i, F.concat(F.lit(" "), x["p_name"], F.lit(" "))))))
    # The claims of a document are its first, so those refused are left out by the SQL as well.
    said = F.transform(F.slice("l", 1, 15), lambda x, i: F.struct(F.when(i % 3 == 0, F.repeat(x["p_name"], F.lit(90))).otherwise(F.concat(x["p_name"], F.lit(" sold"))).alias("text"), F.when(i % 2 == 0, "definition").otherwise("strange").alias("claim_kind"), F.lit(None).cast("double").alias("confidence")))
    more = F.transform("l", lambda x: F.struct(F.lit("late").alias("text"), F.lit("fact").alias("claim_kind"), F.lit(0.5).alias("confidence")))
    tied = F.transform("l", lambda x: F.struct(x["p_name"].alias("from_name"), F.repeat(F.lit("related "), F.lit(8)).alias("relation_type"), x["p_type"].alias("to_name"), x["w"].alias("confidence")))
    docs = c.select("source_id", F.lit("lines").alias("summary"), entities.alias("entities"), F.concat(said, F.when(F.size("l") >= 15, more).otherwise(F.slice(more, 1, 0))).alias("claims"), tied.alias("relations"), F.transform("l", lambda x: x["p_name"]).alias("topic_labels"), F.transform("l", lambda x: x["p_type"]).alias("quality_flags"))
    n = normalize.clean(docs)
    show = lambda c, f: F.array_join(F.transform(c, f), ";")
    return n.select(
        "source_id", show("entities", lambda e: F.concat_ws("/", e["name"], e["entity_type"], F.array_join(e["aliases"], ","))).alias("entities"), F.nullif(show("claims", lambda c: F.concat_ws("/", c["text"], c["claim_kind"])), F.lit("")).alias("claims"),
        show("relations", lambda r: F.concat(r["from_name"], F.lit(">"), r["to_name"], F.lit("/"), r["relation_type"])).alias("relations"), F.array_join("topic_labels", ";").alias("labels"), F.array_join("quality_flags", ";").alias("flags"),
    )


# --- search ----------------------------------------------------------------


@query(f"""
WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term
""")
def fts_term_stats(spark, d):
    return search.term_stats(search.postings(units(spark, d)))


_stored: dict[tuple, Index] = {}


def stored_index(spark, d) -> Index:
    """The index of all documents, which outlives a query: built when a session first
    searches these files, and again when one of them has changed."""
    key = (spark.sparkContext.applicationId, file_states(table(spark, d, "documents")))
    if key not in _stored:
        _stored[key] = Index.build(units(spark, d), new_folder(spark, "index"))
    return _stored[key]


@query(f"WITH w AS (SELECT {WORDS.format('text')} AS w FROM documents) SELECT count(*) AS units, sum(len(w))::BIGINT AS words, sum(len(list_distinct(w)))::BIGINT AS postings FROM w")
def fts_index_build(spark, d):
    """FTS-02: what a new index of all documents holds, counted in its files."""
    index = Index.build(units(spark, d), new_folder(spark, "index"))
    own = index.units().agg(F.count("*").alias("units"))
    return own.crossJoin(index.blocks().agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"), F.sum("n").cast("long").alias("postings")))  # one row each


def _bm25(query: str, where: str = "true", recursive: bool = False) -> str:
    terms = search.query_tokens(query)
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = [f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)" for i in range(len(terms))]
    score = " + ".join(f"{idf[i]} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    return f"""
WITH {'RECURSIVE ' * recursive}w AS (SELECT doc_id, lang, text, {WORDS.format('text')} AS w FROM documents), c AS (SELECT doc_id, lang, text, len(w) AS dl, {tf} FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM c),
h AS (SELECT doc_id, lang, text, ({score})::DOUBLE AS score FROM c, s WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))} AND {where}),
top AS (SELECT * FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 20)"""


TRUST = "CASE WHEN quality = 1 AND toxic = 0 THEN 2.0 WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.5 ELSE 0.3 END"


@query(f"{_bm25('that tion')} SELECT top.doc_id, round(score * {TRUST}, 6) AS score, substr(text, 1, 500) AS excerpt FROM top LEFT JOIN labels USING (doc_id)")
def fts_bm25_search(spark, d):
    """FTS-01..06: the flagship search through the stored index, boosted by each source's trust."""
    hits = search.search(units(spark, d), "that tion", sources=trust(spark, d), index=stored_index(spark, d))
    return hits.select(F.col("unit_id").alias("doc_id"), F.round("score", 6).alias("score"), "excerpt")


@query(f"{_bm25('que', where=chr(39) + 'fr' + chr(39) + ' = lang')} SELECT doc_id, lang, round(score, 6) AS score FROM top")
def fts_unit_type_filter(spark, d):
    hits = search.search(units(spark, d), "que", unit_types=["fr"], index=stored_index(spark, d))
    return hits.select(F.col("unit_id").alias("doc_id"), F.col("unit_type").alias("lang"), F.round("score", 6).alias("score"))


@query("""
WITH p AS (SELECT 'page' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN lower(c_name) = 'customer#0001' THEN 10.0 ELSE 5.0 END AS score FROM customer WHERE lower(c_name) LIKE '%1%' ORDER BY c_name, c_custkey LIMIT 10),
e AS (SELECT 'entity' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_name = '1' THEN 8.0 ELSE 4.0 END AS score FROM part WHERE lower(p_name) LIKE '%1%' ORDER BY p_partkey LIMIT 10)
SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM e) ORDER BY score DESC, kind = 'entity', id LIMIT 10
""")
def fts_exact_search(spark, d):
    """FTS-07: customers as pages, parts as entities."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("active").alias("status"))
    return search.exact_search(c, parts(spark, d), "1").select("kind", "id", "name", F.col("score").cast("double").alias("score"))


@query(f"""
WITH RECURSIVE {PART_EDGES}, b AS (SELECT from_id AS x, to_id AS y, id, relation_type FROM e UNION ALL SELECT to_id, from_id, id, relation_type FROM e),
h1 AS (SELECT y AS id, 1 AS hop, arg_min(relation_type, b.id) AS relation_type FROM b WHERE x IN (1, 2, 3) GROUP BY y HAVING y NOT IN (1, 2, 3)),
h2 AS (SELECT y AS id, 2 AS hop, arg_min(relation_type, b.id) AS relation_type FROM b WHERE x IN (SELECT id FROM h1) GROUP BY y HAVING y NOT IN (1, 2, 3) AND y NOT IN (SELECT id FROM h1))
SELECT * FROM h1 UNION ALL SELECT * FROM h2
""")
def fts_relation_expand(spark, d):
    """FTS-08: two hops from three parts."""
    seeds = table(spark, d, "part").where("p_partkey IN (1, 2, 3)").select(F.col("p_partkey").alias("id"))
    return search.relation_expand(part_edges(spark, d), seeds, 2).select("id", "hop", "relation_type")


# --- entity resolution -----------------------------------------------------


LOTS = f"""lot AS (SELECT p_partkey AS id, p_type AS t, p_name || ' ' || p_brand AS name, p_brand || ' batch ' || (p_partkey // 40) AS a1, 'size ' || p_size || ' of ' || (p_partkey // 100) AS a2, p_size / 50.0 AS c FROM part),
k AS (SELECT DISTINCT id, t, {KEY.format('x')} AS key FROM (SELECT id, t, unnest([name, a1, a2]) AS x FROM lot) WHERE {KEY.format('x')} <> '')"""


@query(f"WITH {LOTS} SELECT a.id, min(b.id) AS match_id FROM k a JOIN k b ON a.t = b.t AND a.key = b.key WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY a.id")
def res_key_match(spark, d):
    """RES-02/03, JOI-18: parts of odd keys, as incoming ones, against the others, by names and aliases."""
    p = lot_parts(spark, d)
    return resolve.match(p.where("id % 2 = 1"), p.where("id % 2 = 0"))


CLUSTERS = f"""RECURSIVE {LOTS}, r AS (SELECT id, id AS x FROM lot UNION SELECT r.id, b.id FROM r JOIN k a ON a.id = r.x JOIN k b ON a.t = b.t AND a.key = b.key),
m AS (SELECT r.id, min(x) AS root, arg_max(x, (c, x)) AS winner FROM r JOIN lot ON lot.id = r.x GROUP BY r.id)"""


@query(f"WITH {CLUSTERS} SELECT id, root, winner FROM m")
def res_components(spark, d):
    """RES-04/05: chains of parts through shared names and aliases."""
    return resolve.clusters(lot_parts(spark, d))


@query(f"""
WITH {CLUSTERS}, {PART_EDGES}, x AS (SELECT e.id, a.winner AS from_id, relation_type, b.winner AS to_id FROM e JOIN m a ON e.from_id = a.id JOIN m b ON e.to_id = b.id)
SELECT from_id, relation_type, to_id, min(id) AS id FROM x WHERE from_id <> to_id GROUP BY ALL
""")
def res_merge_edges(spark, d):
    found = resolve.clusters(lot_parts(spark, d))
    return resolve.merged_relations(part_edges(spark, d), found).select("from_id", "relation_type", "to_id", "id")


@query(f"WITH {CLUSTERS}, s AS (SELECT root, count(*) AS n FROM m GROUP BY root) SELECT CAST(sum(n - 1) AS BIGINT) AS merged, count(*) FILTER (n > 1) AS clusters FROM s")
def res_stats(spark, d):
    return resolve.stats(resolve.clusters(lot_parts(spark, d)))


@query(f"""
WITH {CLUSTERS}, n AS (SELECT winner, count(*) OVER (PARTITION BY winner) AS size, unnest([name, a1, a2]) AS x FROM m JOIN lot ON lot.id = m.id),
s AS (SELECT winner, string_agg(DISTINCT x, '|' ORDER BY x) AS aliases FROM n JOIN lot ON lot.id = winner WHERE x <> name AND size > 1 GROUP BY 1)
SELECT w.id, CASE WHEN (SELECT count(*) FROM m WHERE m.winner = w.id) > 1 THEN coalesce(s.aliases, '') ELSE a1 || '|' || a2 END AS aliases FROM lot w LEFT JOIN s ON s.winner = w.id WHERE w.id IN (SELECT winner FROM m)
""")
def res_merge_entities(spark, d):
    p = lot_parts(spark, d)
    return resolve.merged_entities(p, resolve.clusters(p)).select("id", F.array_join("aliases", "|").alias("aliases"))


# --- checks ----------------------------------------------------------------


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def chk_orphan_page(spark, d):
    """CHK-01: orders as pages (those of low priority are indexes), returned lines as their sources."""
    p = wiki(spark, d).withColumn("page_type", F.when(F.col("page_type") == "5-LOW", "index").otherwise("concept"))
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("page").alias("from_kind"), F.col("l_orderkey").alias("from_id"), F.lit("derived_from").alias("relation_type"))
    return checks.orphan_pages(p, r).select("id")


@query()
def chk_duplicate_entity(spark, d):
    """CHK-02 over all parts; a similarity that SQL has not."""
    return checks.duplicate_entities(named_parts(spark, d)).select(F.col("b_id").alias("id"), F.col("a_id").alias("resembles"), F.round("ratio", 6).alias("ratio"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 10 AS confidence FROM lineitem WHERE l_linestatus = 'O' AND l_discount * 10 < 0.4 ORDER BY 2, 1 LIMIT 50")
def chk_weak_claim(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_linestatus") == "O", "active").otherwise("archived").alias("status"))
    return checks.weak_claims(c).select("id", "confidence")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY ORDER BY o_orderdate, o_orderkey LIMIT 50")
def chk_stale_page(spark, d):
    return checks.stale_pages(wiki(spark, d), F.lit("2001-08-01").cast("timestamp")).select("id", F.col("updated_at").cast("date").alias("updated"))


@query("""
WITH f AS (SELECT p_partkey AS id, lower(substr(p_name, 1, 20)) AS n FROM part ORDER BY p_partkey LIMIT 100),
s AS (SELECT DISTINCT l_partkey AS e, l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT id FROM f)),
p AS (SELECT a.e AS a_id, b.e AS b_id, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a_id, b_id, shared FROM p JOIN f x ON x.id = a_id JOIN f y ON y.id = b_id
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 50 AND p_partkey <= 40 AND (contains(lower(p_name), x.n) OR contains(lower(p_name), y.n))) ORDER BY shared DESC, a_id, b_id LIMIT 10
""")
def chk_missing_comparison(spark, d):
    """CHK-05: parts as concepts, suppliers as sources; some parts' names stand for comparison pages."""
    p = table(spark, d, "part")
    ev = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("source_id"))
    comparison = p.where("p_size = 50 AND p_partkey <= 40").select(F.lit("comparison").alias("page_type"), F.col("p_name").alias("title"))
    return checks.missing_comparisons(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ev, comparison).select("a_id", "b_id", "shared")


@query("""
WITH f AS (SELECT event_type AS finding_type, CAST(user_id AS VARCHAR) AS subject_id, min(CAST(value AS VARCHAR)) AS summary FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2)
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = f.finding_type AND CAST(e.user_id AS VARCHAR) = f.subject_id AND e.event_id % 50 = 0)
""")
def chk_findings_upsert(spark, d):
    """CHK-06: errors and views as findings; every fiftieth event is one already open."""
    e = table(spark, d, "events")
    row = e.select(F.col("event_type").alias("finding_type"), F.col("user_id").cast("string").alias("subject_id"), F.col("value").cast("string").alias("summary"), F.lit("low").alias("severity"), "event_id")
    stored = row.where("event_id % 50 = 0").withColumn("status", F.lit("open"))
    return checks.upsert_findings(stored, row.where("finding_type IN ('error', 'view')")).select("finding_type", "subject_id", "summary")


@query("SELECT event_type AS finding_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def chk_finding_totals(spark, d):
    """AGG-10, with the total."""
    return checks.finding_totals(table(spark, d, "events").withColumnRenamed("event_type", "finding_type"))


# --- knowledge map ---------------------------------------------------------


@query("SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY 1")
def map_support(spark, d):
    s = graph.support(parts(spark, d), item_edges(spark, d))
    return s.groupBy("entity_id").agg(F.count("*").alias("sources"))


NODES = """n AS (SELECT p_partkey AS id, p_name AS name, p_size / 50.0 AS c, coalesce(k, 0) AS sources, p_size / 50.0 + 0.35 * coalesce(k, 0) - CASE WHEN coalesce(k, 0) = 0 THEN 0.5 ELSE 0 END AS score
  FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, lower(name), c DESC, name, id) AS rank FROM n QUALIFY rank <= 140)"""


def _nodes(spark, d):
    e, r = parts(spark, d), item_edges(spark, d)
    s = graph.support(e, r)
    blank = e.withColumns({"page_id": F.lit(None).cast("bigint"), "page_title": F.lit(None).cast("string"), "body": F.lit(None).cast("string")})
    n = written(graph.node_terms(graph.select_nodes(blank, s)), "nodes")
    return n, s


@query(f"WITH {NODES} SELECT id, rank, sources, round(score, 6) AS score FROM top")
def map_node_score(spark, d):
    n, _ = _nodes(spark, d)
    return n.select("id", F.col("rank").cast("long").alias("rank"), F.col("source_count").alias("sources"), F.round("score", 6).alias("score"))


EXPLICIT = f"""{PART_EDGES}, x AS (
  SELECT least(from_id, to_id) AS source, greatest(from_id, to_id) AS target, arg_min(relation_type, (relation_type = 'related_to', id)) AS relation_type,
         max(greatest(0.62, 0.55 + coalesce(nullif(confidence, 0), 0.6) * 0.55)) AS weight, count(*) AS evidence_count
  FROM e WHERE from_id <> to_id AND from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top) GROUP BY 1, 2)"""


@query(f"WITH {NODES}, {EXPLICIT} SELECT source, target, relation_type, round(weight, 6) AS weight, evidence_count FROM x")
def map_explicit_edges(spark, d):
    n, _ = _nodes(spark, d)
    return graph.explicit_edges(part_edges(spark, d), n).select("source", "target", "relation_type", F.round("weight", 6).alias("weight"), "evidence_count")


NAMED = r"regexp_replace(regexp_extract({0}, '^[^\x20\x09-\x0D]+(?: [^\x20\x09-\x0D]+){{3}}'), '[\[\]|#]', '', 'g')"


@query(rf"""
WITH n AS (SELECT doc_id AS id, {NAMED.format('text')} AS name, text FROM documents), b AS (SELECT id, name, lower(text || ' see [[' || lead(name, 1, '') OVER (ORDER BY id) || ']]') AS low, lead(name, 1, '') OVER (ORDER BY id) AS link FROM n),
p AS (SELECT *, regexp_replace(low, '[^a-z0-9]+', '', 'g') AS compact FROM b),
r AS (SELECT id, trim(lower(name)) AS raw FROM n), o AS (SELECT id, unnest([raw, CASE WHEN raw LIKE '%s' AND length(raw) > 4 THEN raw[:-2] ELSE raw END]) AS x FROM r),
v AS (SELECT DISTINCT id, trim(unnest([x, replace(x, '-', ' '), regexp_replace(x, '[^a-z0-9]+', '', 'g')])) AS v FROM o),
m AS (SELECT DISTINCT p.id, v.id AS other FROM p JOIN v ON p.id <> v.id AND v.v <> '' AND CASE WHEN regexp_matches(v.v, '[ -]') THEN contains(p.low, v.v) ELSE regexp_full_match(v.v, '[\p{{L}}\p{{N}}]{{4,}}') AND contains(p.compact, v.v) END),
l AS (SELECT DISTINCT p.id, n.id AS other FROM p JOIN n ON lower(n.name) = lower(trim(p.link)) AND n.id <> p.id WHERE p.link <> '')
SELECT id, other, CASE WHEN (id, other) IN (SELECT (id, other) FROM l) THEN 'wiki_link' ELSE 'page_reference' END AS relation_type FROM (SELECT * FROM m UNION SELECT * FROM l)
""")
def map_text_edges(spark, d):
    """MAP-06, JOI-15/16: all documents as nodes, named by their first four words, each
    linking to the next: which whole text links to or mentions which other's name."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    name = F.regexp_replace(F.regexp_extract("text", r"^[^\x20\x09-\x0D]+(?: [^\x20\x09-\x0D]+){3}", 0), r"[\[\]|#]", "")
    named = written(t.select("id", name.alias("display_name")), "named")  # texts are read again, not written
    following = named.select((F.col("id") - 1).alias("id"), F.col("display_name").alias("next"))
    j = t.join(named.join(following, "id", "left"), "id")
    body = F.concat("text", F.lit(" see [["), F.coalesce("next", F.lit("")), F.lit("]]"))
    n = j.select("id", "display_name", F.lit(None).cast("string").alias("page_title"), body.alias("body"))
    return graph.text_edges(n, titles=False).select("id", "other", "relation_type")


def part_pages(spark, d) -> DataFrame:
    """Concept pages about parts: each says what its part is and links to the page of
    the part that follows it in an order; parts of every fifth size have archived ones."""
    p = table(spark, d, "part")
    title = F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")))
    pages = p.select(F.col("p_partkey").alias("id"), title.alias("title"), "p_name", F.lower("p_type").alias("t"), F.when(F.col("p_size") % 5 == 0, "archived").otherwise("active").alias("status"))
    following = part_edges(spark, d).groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("to_id"))
    following = following.join(pages.select(F.col("id").alias("to_id"), F.concat(F.lit(" See [["), "title", F.lit("]].")).alias("see")), "to_id").select("id", "see")
    body = F.concat(F.lit("# "), "title", F.lit("\n\nThe "), "p_name", F.lit(" is sold as "), "t", F.lit("."), F.coalesce("see", F.lit("")))
    return pages.join(following, "id", "left").select("id", F.lit("concept").alias("page_type"), "title", body.alias("body"), "status")


def _edges(spark, d):
    """The map of parts with their pages: nodes, their sources and all edges."""
    e, r, p = parts(spark, d), item_edges(spark, d), part_pages(spark, d)
    about = p.select(F.lit("page").alias("from_kind"), F.col("id").alias("from_id"), F.lit("about").alias("relation_type"), F.lit("entity").alias("to_kind"), F.col("id").alias("to_id"))
    s = graph.support(e, r)
    n = written(graph.node_terms(graph.select_nodes(graph.with_pages(e, about, p), s)), "nodes")
    explicit = graph.merge_text_edges(graph.explicit_edges(part_edges(spark, d), n), graph.text_edges(n))
    return n, s, written(graph.map_edges(explicit, graph.shared_pairs(n, s)), "edges")


PAGED = f"""{PART_EDGES},
w0 AS (SELECT p_partkey AS id, p_name || ' ' || replace(p_brand, '#', ' ') AS title, p_name, lower(p_type) AS t, p_size % 5 <> 0 AS live FROM part),
nx AS (SELECT from_id AS id, min(to_id) AS to_id FROM e GROUP BY 1),
w AS (SELECT w0.id, w0.title, '# ' || w0.title || chr(10) || chr(10) || 'The ' || w0.p_name || ' is sold as ' || w0.t || '.' AS head, 'The ' || w0.p_name || ' is sold as ' || w0.t || '.' || coalesce(' See ' || l.title || '.', '') AS summary,
             coalesce(' See [[' || l.title || ']].', '') AS see, l.title AS link FROM w0 LEFT JOIN nx USING (id) LEFT JOIN w0 l ON l.id = nx.to_id WHERE w0.live),
s AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS s FROM lineitem),
top AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS entity_type, p_size / 50.0 AS c, coalesce(k, 0) AS sources, title AS page_title, head || see AS body, link, coalesce(summary, p_name || ' is a ' || p_type || '.') AS summary,
         row_number() OVER (ORDER BY round(p_size / 50.0 + 0.35 * coalesce(k, 0) + CASE WHEN title IS NOT NULL THEN 0.75 WHEN coalesce(k, 0) = 0 THEN -0.5 ELSE 0 END, 9) DESC, lower(p_name), p_size DESC, p_name, p_partkey) AS rank
  FROM part LEFT JOIN (SELECT e, count(*) AS k FROM s GROUP BY 1) ON e = p_partkey LEFT JOIN w ON w.id = p_partkey QUALIFY rank <= 140),
tk AS (SELECT id, unnest(regexp_extract_all(z, '[a-z0-9][a-z0-9+-]+')) AS term, unnest(range(len(regexp_extract_all(z, '[a-z0-9][a-z0-9+-]+')))) AS i FROM (SELECT id, lower(concat_ws(' ', name, summary, body)) AS z FROM top)),
tm AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS k FROM tk WHERE term NOT IN ({STOP}) AND NOT regexp_full_match(term, '[0-9]+') AND length(term) > 2 GROUP BY id, term QUALIFY k <= 16),
x AS (
  SELECT least(from_id, to_id) AS source, greatest(from_id, to_id) AS target, arg_min(relation_type, (relation_type = 'related_to', id)) AS relation_type,
         max(greatest(0.62, 0.55 + coalesce(nullif(confidence, 0), 0.6) * 0.55)) AS weight, count(*) AS evidence_count, list(DISTINCT evidence_source_id) AS srcs
  FROM e WHERE from_id <> to_id AND from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top) GROUP BY 1, 2),
f AS (
  SELECT a.id, b.id AS other, a.page_title, lower(a.link) IN (lower(b.name), lower(b.page_title)) AS linked FROM top a JOIN top b ON a.id <> b.id AND a.body IS NOT NULL
   AND (coalesce(lower(a.link) IN (lower(b.name), lower(b.page_title)), false) OR contains(lower(a.body), b.name) OR contains(lower(a.body), lower(b.page_title)))),
t AS (SELECT least(id, other) AS source, greatest(id, other) AS target, count(*) AS n, max(coalesce(linked, false)) AS linked, list_sort(list(DISTINCT page_title)) AS titles FROM f GROUP BY 1, 2),
strong AS (
  SELECT coalesce(x.source, t.source) AS source, coalesce(x.target, t.target) AS target,
         CASE WHEN t.linked THEN 'wiki_link' WHEN t.n IS NOT NULL AND coalesce(x.relation_type, 'related_to') = 'related_to' THEN 'page_reference' ELSE x.relation_type END AS relation_type,
         greatest(x.weight, CASE WHEN t.linked THEN 0.86 WHEN t.n IS NOT NULL THEN 0.72 END) AS weight, coalesce(x.evidence_count, 0) + coalesce(t.n, 0) AS evidence_count, coalesce(x.srcs, []) AS srcs, coalesce(t.titles, []) AS titles
  FROM x FULL JOIN t ON x.source = t.source AND x.target = t.target),
sp AS (
  SELECT a, b, least(a, b) AS source, greatest(a, b) AS target, shared, srcs, coalesce(lexical, 0) AS lexical
  FROM (SELECT u.id AS a, v.id AS b, count(*) AS shared, list(i.s) AS srcs FROM s i JOIN s j ON i.s = j.s JOIN top u ON u.id = i.e JOIN top v ON v.id = j.e WHERE u.rank < v.rank GROUP BY 1, 2)
  LEFT JOIN (SELECT i.id AS a, j.id AS b, count(*) AS lexical FROM tm i JOIN tm j ON i.term = j.term AND i.k <= 8 AND j.k <= 8 GROUP BY 1, 2) USING (a, b) WHERE shared > 1 OR lexical > 0),
weak AS (
  SELECT *, round(0.14 + least(0.34, 0.08 * shared + 0.05 * lexical), 4) AS weight FROM sp ANTI JOIN strong USING (source, target)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(0.14 + least(0.34, 0.08 * shared + 0.05 * lexical), 4) DESC, b) <= 4),
g AS (
  SELECT st.source, st.target, st.relation_type, 'explicit' AS kind, st.weight, coalesce(shared, 0) AS shared, evidence_count, coalesce(lexical, 0) AS lexical, list_sort(list_distinct(list_concat(st.srcs, coalesce(sp.srcs, [])))) AS srcs, titles FROM strong st LEFT JOIN sp USING (source, target)
  UNION ALL SELECT source, target, 'shared_source', 'inferred', weight, shared, shared, lexical, list_sort(srcs), [] FROM weak)"""


@query(f"""
WITH {NODES}, s AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS s, rank FROM lineitem JOIN top ON top.id = l_partkey)
SELECT a.e AS a, b.e AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.rank < b.rank GROUP BY 1, 2 HAVING count(*) > 1
""")
def map_shared_pairs(spark, d):
    """JOI-13 for pairs with two shared sources or more."""
    n, s = _nodes(spark, d)
    return graph.shared_pairs(n, s).where("shared > 1").select("a", "b", "shared")


@query(f"WITH {PAGED} SELECT id, rank, page_title, summary, string_agg(term, ' ' ORDER BY k) AS terms FROM top JOIN tm USING (id) GROUP BY ALL")
def map_paged_nodes(spark, d):
    """MAP-01, MAP-03, MAP-04: nodes with their pages, summaries and terms."""
    n, _, _ = _edges(spark, d)
    return n.select("id", F.col("rank").cast("long").alias("rank"), "page_title", "summary", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {PAGED} SELECT source, target, relation_type, kind, round(weight, 6) AS weight, shared AS shared_sources, evidence_count, lexical AS lexical_overlap, array_to_string(srcs, ',') AS sources, array_to_string(titles, ',') AS page_titles FROM g")
def map_all_edges(spark, d):
    """MAP-05..07, AGG-04, AGG-16: relations, links and names in pages, and shared sources, merged."""
    _, _, e = _edges(spark, d)
    texts = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(k) for c, k in (("evidence_sources", "sources"), ("page_titles", "page_titles"))]
    return e.select("source", "target", "relation_type", "kind", F.round("weight", 6).alias("weight"), "shared_sources", "evidence_count", "lexical_overlap", *texts)


@query(f"WITH {PAGED} SELECT source, target, weight, shared AS shared_sources, lexical AS lexical_overlap FROM g WHERE kind = 'inferred'")
def map_inferred_edges(spark, d):
    _, _, e = _edges(spark, d)
    return e.where("kind = 'inferred'").select("source", "target", "weight", "shared_sources", "lexical_overlap")


@query(f"""
WITH {NODES}, {EXPLICIT}, b AS (SELECT source AS id, weight FROM x UNION ALL SELECT target, weight FROM x)
SELECT id, count(*) AS degree, round(sum(weight), 6) AS weighted_degree FROM b GROUP BY id
""")
def map_degree(spark, d):
    """AGG-05 over the explicit edges."""
    n, _ = _nodes(spark, d)
    return graph.degrees(graph.explicit_edges(part_edges(spark, d), n)).select("id", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


@query(f"""
WITH {NODES}, {EXPLICIT}, b AS (SELECT source AS id, target AS other, weight FROM x UNION ALL SELECT target, source, weight FROM x)
SELECT b.id, other, row_number() OVER (PARTITION BY b.id ORDER BY round(weight, 9) DESC, lower(name), other) AS place FROM b JOIN top ON top.id = other QUALIFY place <= 8
""")
def map_neighbors_top8(spark, d):
    n, _ = _nodes(spark, d)
    e = graph.explicit_edges(part_edges(spark, d), n).withColumn("weight", F.round("weight", 9))
    return graph.neighbours(e, n).select("id", "other", F.col("place").cast("long").alias("place"))


@query(f"""
WITH {NODES}, {EXPLICIT}, b AS (SELECT source AS id FROM x UNION ALL SELECT target FROM x), g AS (SELECT id, count(*) AS degree FROM b GROUP BY id)
SELECT id, coalesce(degree, 0) AS degree, sources AS source_count FROM top LEFT JOIN g USING (id) ORDER BY coalesce(degree, 0) DESC, sources DESC, lower(name), id LIMIT 10
""")
def map_hubs(spark, d):
    n, _ = _nodes(spark, d)
    g = graph.degrees(graph.explicit_edges(part_edges(spark, d), n))
    j = n.join(g, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "source_count", F.col("display_name").alias("label"))
    return graph.hubs(j).drop("label")


@query()
def map_groups(spark, d):
    n, s, e = _edges(spark, d)
    return graph.group_stats(n, e, graph.node_groups(n, e, s), s).select("group", "label", "size", F.array_join("themes", ", ").alias("themes"), "explicit_edge_count", "inferred_edge_count", "source_count", "rationale")


@query(f"""
WITH {PAGED}, i AS (SELECT g.*, a.entity_type AS grp FROM g JOIN top a ON a.id = source JOIN top b ON b.id = target AND a.entity_type = b.entity_type),
c AS (SELECT grp, count(*) FILTER (kind = 'explicit') AS explicit_edge_count, count(*) FILTER (kind = 'inferred') AS inferred_edge_count FROM i GROUP BY 1),
sc AS (SELECT entity_type AS grp, count(DISTINCT s) AS source_count FROM top JOIN s ON s.e = top.id GROUP BY 1),
nw AS (SELECT id, sum(weight) AS w FROM (SELECT source AS id, weight FROM i UNION ALL SELECT target, weight FROM i) GROUP BY 1),
m AS (SELECT entity_type AS grp, name, row_number() OVER (PARTITION BY entity_type ORDER BY round(coalesce(w, 0) + c + 0.12 * sources, 9) DESC, lower(name), id) AS r FROM top LEFT JOIN nw USING (id)),
z AS (SELECT grp, count(*) AS size, string_agg(name, ' + ' ORDER BY r) FILTER (r <= 2) AS label FROM m GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tm GROUP BY 1),
lc AS (SELECT entity_type AS grp, term, count(*) * 1.35::DOUBLE / any_value(df) AS score FROM tm JOIN top USING (id) JOIN df USING (term) WHERE k <= 10 GROUP BY 1, 2),
th AS (SELECT grp, term, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS r FROM lc QUALIFY r <= 3),
ty AS (SELECT grp, string_agg(CASE WHEN regexp_full_match(term, '[a-z]{{1,3}}') OR term IN ({', '.join(f"'{w}'" for w in tx.ACRONYMS)}) THEN upper(term) ELSE upper(term[1]) || term[2:] END, ', ' ORDER BY r) AS themes FROM th GROUP BY 1),
q AS (SELECT grp, label, size, themes, coalesce(explicit_edge_count, 0) AS n, coalesce(inferred_edge_count, 0) AS i, coalesce(source_count, 0) AS c FROM z JOIN ty USING (grp) LEFT JOIN c USING (grp) LEFT JOIN sc USING (grp))
SELECT grp AS "group", label, size, themes, n AS explicit_edge_count, i AS inferred_edge_count, c AS source_count,
  'Grouped around ' || themes || coalesce(', with ' || nullif(concat_ws(', ', CASE WHEN n > 0 THEN n || ' explicit link' || CASE WHEN n = 1 THEN '' ELSE 's' END END, CASE WHEN i > 0 THEN i || ' inferred overlap link' || CASE WHEN i = 1 THEN '' ELSE 's' END END,
    CASE WHEN c > 0 THEN 'support spread across ' || c || ' source' || CASE WHEN c = 1 THEN '' ELSE 's' END END), ''), '') || '.' AS rationale FROM q
""")
def map_type_profiles(spark, d):
    """MAP-13, AGG-03/06/07, WIN-03/04, SCA-23/39: the figures of groups, here of one for each type."""
    n, s, e = _edges(spark, d)
    g = n.select("id", F.col("entity_type").alias("group"))
    return graph.group_stats(n, e, g, s).select("group", "label", "size", F.array_join("themes", ", ").alias("themes"), "explicit_edge_count", "inferred_edge_count", "source_count", "rationale")


def _whole_map(spark, d) -> dict[str, DataFrame]:
    about = part_pages(spark, d).select((-1 - F.col("id")).alias("id"), F.lit("page").alias("from_kind"), F.col("id").alias("from_id"), F.lit("about").alias("relation_type"), F.lit("entity").alias("to_kind"), F.col("id").alias("to_id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("bigint").alias("evidence_source_id"))
    relations = item_edges(spark, d).unionByName(part_edges(spark, d)).unionByName(about)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"))
    return graph.knowledge_map(parts(spark, d), relations, part_pages(spark, d), orders)


@query(f"""
WITH {PAGED}, b AS (SELECT source AS id, target AS other, weight FROM g UNION ALL SELECT target, source, weight FROM g), dg AS (SELECT id, count(*) AS degree FROM b GROUP BY 1),
nb AS (SELECT b.id, other, row_number() OVER (PARTITION BY b.id ORDER BY round(weight, 3) DESC, lower(name), other) AS place FROM b JOIN top ON top.id = other QUALIFY place <= 8),
ld AS (SELECT id, string_agg(other, ' ' ORDER BY place) AS lead FROM nb GROUP BY 1)
SELECT top.id, name AS label, summary, page_title, sources AS source_count, coalesce(degree, 0) AS degree, round(c, 3) AS confidence, lead,
       round(('0x' || substr(sha256(CAST(top.id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE - 0.5, 6) AS seed
FROM top LEFT JOIN dg ON dg.id = top.id LEFT JOIN ld ON ld.id = top.id
""")
def map_records(spark, d):
    """MAP-14, MAP-17: the nodes of the whole map as they are shown, with their lead ideas."""
    lead = F.array_join(F.transform("lead_ideas", lambda x: x["neighbour"].cast("string")), " ")
    return _whole_map(spark, d)["nodes"].select("id", "label", "summary", "page_title", "source_count", "degree", "confidence", lead.alias("lead"), "seed")


@query(f"WITH {PAGED} SELECT (SELECT count(*) FROM top) AS node_count, count(*) AS edge_count, count(*) FILTER (kind = 'explicit') AS explicit_edge_count, count(*) FILTER (kind = 'inferred') AS inferred_edge_count FROM g")
def map_stats(spark, d):
    """MAP-16."""
    return _whole_map(spark, d)["stats"].select("node_count", "edge_count", "explicit_edge_count", "inferred_edge_count")


@query(f"""
WITH {PAGED}, h AS (SELECT *, CASE WHEN len(srcs) = 0 THEN '' ELSE ' (' || array_to_string(list_transform(srcs[1:3], lambda x: 'Order ' || x), ', ') || ')' END AS cite, shared || ' shared source' || CASE WHEN shared = 1 THEN '' ELSE 's' END AS sh FROM g)
SELECT 'edge_' || source || '_' || target AS id, relation_type, kind, round(weight, 3) AS weight, CASE WHEN kind = 'inferred' THEN 'shared_support' WHEN shared > 0 THEN 'hybrid' ELSE 'explicit_relation' END AS provenance_kind,
  CASE WHEN kind = 'inferred' THEN 'Inferred from ' || sh || CASE WHEN lexical > 0 THEN ' and ' || lexical || ' overlapping topical term' || CASE WHEN lexical = 1 THEN '' ELSE 's' END ELSE '' END
  ELSE CASE relation_type WHEN 'wiki_link' THEN 'Explicit wiki link' WHEN 'page_reference' THEN 'Explicit concept-page reference' ELSE 'Explicit relation ' || chr(39) || replace(relation_type, '_', ' ') || chr(39) || CASE WHEN evidence_count > 1 THEN ' seen ' || evidence_count || ' times' ELSE '' END END
    || CASE WHEN len(titles) > 0 THEN ' from ' || array_to_string(titles[1:2], ', ') ELSE '' END || CASE WHEN shared > 0 THEN ', reinforced by ' || sh ELSE '' END END || cite || '.' AS provenance_summary FROM h
""")
def map_edge_provenance(spark, d):
    """MAP-15, SCA-38, WIN-08."""
    _, _, e = _edges(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"))
    return graph.serialised(e, orders).select("id", "relation_type", "kind", "weight", "provenance_kind", "provenance_summary")


# --- compile, ask, jobs ----------------------------------------------------


@query("""
WITH e AS (SELECT CASE lang WHEN 'en' THEN 'concept' WHEN 'fr' THEN 'question' WHEN 'de' THEN 'index' ELSE 'other' END AS bucket, '- [[Doc ' || doc_id || ']] — ' || source AS entry, 'Doc ' || doc_id AS title, doc_id, lang FROM documents)
SELECT bucket, count(*) AS n, md5(string_agg(entry, chr(10) ORDER BY lang, title, doc_id)) AS entries_md5 FROM e GROUP BY bucket
""")
def cmp_index_catalog(spark, d):
    """AGG-09: documents as pages, by language."""
    t = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "en", "concept").when(F.col("lang") == "fr", "question").when(F.col("lang") == "de", "index").otherwise("spanish")
    p = t.select(F.col("doc_id").alias("id"), kind.alias("page_type"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("source").alias("body"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("updated_at"))
    return pages_.index_catalog(p).select("bucket", "n", F.md5(F.array_join("entries", "\n")).alias("entries_md5"))


@query("""
WITH l AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, CAST(o_orderkey AS VARCHAR) AS id, '## [' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || '] ingest | Order ' || o_orderkey || chr(10) || '- Source ID: `' || o_orderkey || '`' || chr(10) || '- Type: ' || o_orderpriority || chr(10) || '- Status: ' || o_orderstatus AS entry FROM orders
  UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(event_id AS VARCHAR), '## [' || strftime(ts, '%Y-%m-%d %H:%M') || '] build | compile_project' || chr(10) || '- Job ID: `' || event_id || '`' || chr(10) || '- Status: ' || event_type FROM events
  UNION ALL SELECT '', conv_id || '.' || turn, '## [unknown] query | ' || substr(CASE WHEN trim(text) = '' THEN conv_id || '.' || turn ELSE trim(text) END, 1, 80) || chr(10) || '- Query Run ID: `' || conv_id || '.' || turn || '`' || chr(10) || '- Task type: answer' || chr(10) || '- Status: succeeded' FROM conversations WHERE role = 'user')
SELECT c AS created_at, id, md5(entry) AS entry_md5 FROM l
""")
def cmp_project_log(spark, d):
    """SET-04: orders as ingests, user turns as queries, events as builds."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    s = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderstatus").alias("status"), stamp("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("deleted_at"))
    r = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.col("text").alias("prompt_text"), F.lit("answer").alias("task_type"), F.lit("succeeded").alias("status"), F.lit("").alias("created_at"), F.lit(None).cast("string").alias("result_artifact_id"))
    j = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("compile_project").alias("job_type"), F.col("event_type").alias("status"), stamp("ts").alias("created_at"))
    none = spark.createDataFrame([], "id string, title string")
    return pages_.project_log(s, r, none, j).select("created_at", "id", F.md5("entry").alias("entry_md5"))


@query(f"""
WITH {PART_EDGES}, b AS (SELECT from_id AS id, to_id AS other, relation_type, confidence FROM e UNION ALL SELECT to_id, from_id, relation_type, confidence FROM e),
r AS (SELECT b.id, p_name || ' (' || relation_type || ')' AS line, row_number() OVER (PARTITION BY b.id ORDER BY confidence DESC, p_name, relation_type, other) AS k FROM b JOIN part ON p_partkey = other)
SELECT id, string_agg(line, '; ' ORDER BY k) AS relationships FROM r WHERE k <= 6 GROUP BY id
""")
def cmp_concept_context(spark, d):
    """JOI-07, SRT-06."""
    return pages_.concept_context(parts(spark, d), part_edges(spark, d)).select("id", F.array_join("relationships", "; ").alias("relationships"))


@query()
def cmp_source_pages(spark, d):
    """CMP-01 over all documents."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), "text")
    return pages_.source_pages(normalize.extract(s)).select(F.col("origin_id").alias("doc_id"), "slug", "file_path", "token_count", "body_sha256")


@query("SELECT DISTINCT l_orderkey AS page_id, l_suppkey AS source_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ask_expand_sources(spark, d):
    """JOI-19: urgent orders as pages, suppliers as the sources they derive from."""
    r = table(spark, d, "lineitem").select(F.lit("page").alias("from_kind"), F.col("l_orderkey").alias("from_id"), F.lit("derived_from").alias("relation_type"), F.lit("source").alias("to_kind"), F.col("l_suppkey").alias("to_id"))
    p = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("page_id"))
    return ask.expand_sources(p, r).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("source_id").cast("bigint").alias("source_id"))


EVIDENCE = f"""{_bm25('that tion', recursive=True)},
{PART_EDGES},
p AS (SELECT doc_id AS id, substr(text, 1, 30) AS title FROM documents),
ph AS (SELECT CAST(id AS VARCHAR) AS id, 'page' AS kind, CASE WHEN lower(title) = 'hot' THEN 10.0 ELSE 5.0 END AS score FROM (SELECT * FROM p WHERE lower(title) LIKE '%hot%' ORDER BY title, id LIMIT 10)),
eh AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'entity' AS kind, CASE WHEN p_name = 'hot' THEN 8.0 ELSE 4.0 END AS score FROM (SELECT * FROM part WHERE lower(p_name) LIKE '%hot%' ORDER BY p_partkey LIMIT 10)),
hits AS (SELECT * FROM (SELECT * FROM ph UNION ALL SELECT * FROM eh) ORDER BY score DESC, kind = 'entity', id LIMIT 10),
seeds AS (SELECT DISTINCT id FROM hits WHERE kind = 'entity'),
b AS (SELECT CAST(from_id AS VARCHAR) AS x, CAST(to_id AS VARCHAR) AS y, id, confidence FROM e UNION ALL SELECT CAST(to_id AS VARCHAR), CAST(from_id AS VARCHAR), id, confidence FROM e),
near AS (SELECT y AS id, arg_min(confidence, b.id) AS c FROM b WHERE x IN (SELECT id FROM seeds) AND y NOT IN (SELECT id FROM seeds) GROUP BY y ORDER BY c DESC, y LIMIT 15),
about AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT id FROM near UNION SELECT id FROM seeds)),
f AS (SELECT CAST(doc_id AS VARCHAR) AS id, score FROM (SELECT * FROM top LIMIT 15) UNION ALL SELECT id, 1.0 FROM about UNION ALL SELECT id, score FROM hits WHERE kind = 'page'),
best AS (SELECT id, max(score) AS score FROM f GROUP BY id ORDER BY score DESC, id LIMIT 8)
SELECT 'page' AS kind, id, round(score, 6) AS score, (SELECT title FROM p WHERE CAST(p.id AS VARCHAR) = best.id) AS shown FROM best
UNION ALL SELECT 'source', id, NULL, source FROM (SELECT best.id, source FROM best JOIN documents ON CAST(doc_id AS VARCHAR) = best.id ORDER BY 1 LIMIT 5)
UNION ALL SELECT 'claim', CAST(doc_id AS VARCHAR), quality * 0.5, 'label' FROM (SELECT * FROM labels ORDER BY quality DESC, doc_id LIMIT 15)"""


@query(EVIDENCE)
def ask_evidence(spark, d):
    """QRY-02, JOI-05, WIN-09, SRT-07: the evidence for a question through the stored
    index: documents are pages and sources, parts entities, each page about the part of
    its number, labels claims."""
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("body"), F.lit("active").alias("status"))
    sources = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.substring("text", 1, 100).alias("summary"), F.lit(None).cast("timestamp").alias("deleted_at"))
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("claim_text"), (F.col("quality") * 0.5).alias("confidence"), F.lit("active").alias("status"))
    of = lambda rel, kind: docs.select(F.col("doc_id").alias("id"), F.lit("page").alias("from_kind"), F.col("doc_id").alias("from_id"), F.lit(rel).alias("relation_type"), F.lit(kind).alias("to_kind"), F.col("doc_id").alias("to_id"), F.lit(1.0).alias("confidence"))
    relations = part_edges(spark, d).drop("evidence_source_id").unionByName(of("about", "entity")).unionByName(of("derived_from", "source"))
    p = ask.plan("that tion hot", "answer")
    p.terms, p.exact_terms = p.terms[:2], ["hot"]
    found = ask.evidence(p, units(spark, d), pages, parts(spark, d), relations, sources, claims, stored_index(spark, d))
    row = lambda kind, i, score, shown: (F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), score.cast("double").alias("score"), F.col(shown).alias("shown"))
    out = found["pages"].select(*row("page", "page_id", F.round("score", 6), "title"))
    out = out.unionByName(found["sources"].select(*row("source", "source_id", F.lit(None), "title")))
    return out.unionByName(found["claims"].select(*row("claim", "id", F.col("confidence"), "claim_text")))


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS events FROM events GROUP BY 1")
def job_latest_state(spark, d):
    return jobs.latest_state(_events(spark, d))


@query("SELECT event_id, user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_no FROM events")
def job_event_seq(spark, d):
    return jobs.event_seq(_events(spark, d)).select("event_id", "job_id", F.col("seq_no").cast("long").alias("seq_no"))


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END"


def job_events(events: DataFrame) -> DataFrame:
    """Users as jobs, seven projects, kinds of events as what jobs are told to become."""
    return events.select((F.col("user_id") % 7).alias("project_id"), F.col("user_id").alias("job_id"), "ts", "event_id", F.expr(STATUS).alias("status"))


def _stream(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema)
    if events.inputFiles()[0].endswith("/events.parquet"):  # a file among others; streams read folders
        return job_events(source.option("pathGlobFilter", "events.parquet").parquet(d))
    return job_events(source.parquet(f"{d}/events.parquet"))


@query(f"""
WITH e AS (SELECT user_id AS job_id, list({STATUS} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
m AS (SELECT job_id, list_reduce(list_transform(l, lambda x: {{'s': x, 'n': 0}}), lambda a, b:
  CASE WHEN (a.s = '' AND b.s = 'queued') OR (a.s = 'queued' AND b.s IN ('running', 'cancelled')) OR (a.s = 'running' AND b.s IN ('running', 'succeeded', 'failed', 'cancelled'))
       THEN {{'s': b.s, 'n': a.n + 1}} ELSE a END, {{'s': '', 'n': 0}}) AS r, len(l) AS events FROM e)
SELECT job_id, r.s AS status, CAST(r.n AS BIGINT) AS accepted, CAST(events AS BIGINT) AS events FROM m
""")
def job_lifecycle(spark, d):
    """STR-02: each job's final state, from a stream of all events through the state store."""
    at = new_folder(spark, "lifecycle")
    out = lifecycle.run_once(lifecycle.lifecycle(_stream(spark, d)), f"{at}/checkpoint", f"{at}/states")
    return out.groupBy("job_id").agg(F.max_by("status", "seq_no").alias("status"), F.count_if("accepted").alias("accepted"), F.max("seq_no").alias("events"))


@query()
def job_queue(spark, d):
    """STR-01: the order in which each project's jobs start, from a stream of all events."""
    at = new_folder(spark, "queue")
    return lifecycle.run_once(lifecycle.serial_queue(_stream(spark, d)), f"{at}/checkpoint", f"{at}/turns")


# --- further scalar functions, listings and changes ------------------------


@query(rf"""
WITH p AS (SELECT page_id, url, {DOMAIN.format('url')} AS domain, trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages), q AS (SELECT *, CASE WHEN t = '' THEN url ELSE t END AS title FROM p)
SELECT k AS kind, url, title, domain AS folder_path, domain, 1600000000 + page_id AS added FROM q, (VALUES ('netscape'), ('chromium')) v(k)
""")
def src_bookmarks(spark, d):
    """SRC-01/02: all pages as bookmarks, 500 a file, written in both formats and read back."""
    p = table(spark, d, "pages")
    marks = p.select("page_id", "url", tx.collapse(tx.html_title(F.col("html"))).alias("title"), tx.url_domain(F.col("url")).alias("folder"), (F.col("page_id") + 1600000000).alias("added"))
    out = []
    for kind in bookmarks.FRAMES:
        at = new_folder(spark, kind)
        placed = marks.withColumns({"file_path": F.concat(F.lit("b"), F.floor(F.col("page_id") / 500), F.lit(".txt")), "place": F.col("page_id") % 500})
        vault.write_files(bookmarks.file_rows(placed, kind), at, "place")
        out.append(bookmarks.read_bookmarks(spark, at, kind).select(F.lit(kind).alias("kind"), "url", "title", "folder_path", "domain", F.unix_timestamp("added_at").alias("added")))
    return out[0].unionByName(out[1])


@query(r"""
WITH p AS (SELECT page_id, url, html, CASE page_id % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'source_summary' WHEN 2 THEN 'timeline' ELSE 'question' END AS kind, 'Page ' || page_id AS title FROM pages),
b AS (SELECT CASE kind WHEN 'concept' THEN 0 WHEN 'source_summary' THEN 1 WHEN 'question' THEN 2 ELSE 4 END AS k, count(*) AS n, string_agg('- [[' || title || ']] — ' || url || chr(10), '' ORDER BY title) AS t FROM p GROUP BY 1),
i AS (SELECT string_agg(chr(10) || '## ' || name || ' (' || coalesce(n, 0) || ')' || chr(10) || chr(10) || coalesce(t, '_None yet._' || chr(10)), '' ORDER BY h.k) AS t
  FROM (VALUES (0, 'Concepts'), (1, 'Sources'), (2, 'Questions'), (3, 'Indexes'), (4, 'Other Pages')) h(k, name) LEFT JOIN b ON b.k = h.k)
SELECT 'wiki/' || CASE kind WHEN 'concept' THEN 'concepts' WHEN 'source_summary' THEN 'sources' WHEN 'timeline' THEN 'timelines' ELSE 'questions' END || '/page-' || page_id || '.md' AS file_path, sha256(html) AS sha256 FROM p
UNION ALL SELECT 'normalized/' || page_id || '.json', sha256('{"page_id":' || page_id || ',"url":"' || url || '","kind":"' || kind || '"}') FROM p
UNION ALL SELECT 'index.md', sha256(array_to_string(['---', 'page_type: "index"', 'title: "Project Index"', 'project_id: "all"', '---', '', '# Project Index', ''], chr(10)) || t) FROM i
""")
def snk_vault_files(spark, d):
    """SNK-01/03/05/08: all pages as a project's files, committed as one and read back; what
    a second writing of the same rows finds right stays."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("concept", "source_summary", "timeline", "question")]), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", "url", "html", kind.alias("kind"))
    none = {c: F.lit(None).cast("string") for c in ("page_type", "title", "id")}
    wiki = p.select(F.concat_ws("/", F.lit("wiki"), pages_.routed(F.col("kind"), pages_.WIKI, "concepts"), F.concat(F.lit("page-"), "page_id", F.lit(".md"))).alias("file_path"), F.col("html").alias("body"), F.lit(0).alias("place"))
    json = p.select(F.concat(F.lit("normalized/"), "page_id", F.lit(".json")).alias("file_path"), F.to_json(F.struct("page_id", "url", "kind")).alias("body"), F.lit(0).alias("place"))
    known = p.select(F.col("page_id").alias("id"), F.col("kind").alias("page_type"), F.concat(F.lit("Page "), "page_id").alias("title"), F.col("url").alias("body"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("updated_at"))
    index = pages_.index_lines(known, "all").withColumn("file_path", F.lit("index.md"))
    rows, at = wiki.unionByName(json).withColumns(none).unionByName(index), new_folder(spark, "vault")
    for _ in range(2):
        vault.write_files(rows, at, "place", "page_type", "title", "id")
    return vault.digests(spark, at)


@query(r"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS given FROM orders")
def src_pdf_date(spark, d):
    """SRC-10: dates as PDFs write them; others give null."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("D:"), day, F.lit("+00'00'"))).otherwise(F.lit("unknown"))
    return o.select("o_orderkey", tx.pdf_date(day).alias("day"), tx.pdf_date(odd).alias("given"))


@query("SELECT doc_id, md5(text) AS body_md5 FROM documents")
def src_front_matter(spark, d):
    """SRC-15, SCA-08: a header block before every text is taken off again."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(tx.strip_front_matter(F.concat(F.lit("---\ntitle: x\n---\n"), "text"))).alias("body_md5"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 12000) WHEN doc_id % 3 = 1 AND quality IS NOT NULL THEN 'label ' || quality WHEN doc_id % 3 = 1 THEN '' ELSE coalesce('raw ' || html, '') END AS text
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT page_id, substr(html, 1, 11996) AS html FROM pages) ON page_id = doc_id AND doc_id % 3 = 2
""")
def src_source_text(spark, d):
    """SRC-13: a stored text, a sibling's (labels), a raw file's (pages), or none."""
    raw = F.concat(F.lit("p"), "page_id")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("p"), "doc_id")).alias("raw_path"))
    texts = table(spark, d, "labels").where("doc_id % 3 = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("label "), "quality").alias("text"))
    raws = table(spark, d, "pages").select(raw.alias("path"), F.concat(F.lit("raw "), "html").alias("text"))
    return files.source_text(t, texts, raws).select(F.col("id").alias("doc_id"), "text")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'concepts' WHEN 'O' THEN 'sources' ELSE 'concepts' END AS wiki, CASE o_orderstatus WHEN 'F' THEN 'answers' WHEN 'O' THEN 'slides' ELSE 'reports' END AS output, CASE o_orderstatus WHEN 'F' THEN 'papers' WHEN 'O' THEN 'notes' ELSE 'articles' END AS raw FROM orders")
def snk_folders(spark, d):
    """SNK-03, 04, 06: where pages, artifacts and raw files of each kind go."""
    o = table(spark, d, "orders")

    def kind(f, o_, other):
        return F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o_).otherwise(other)

    return o.select(F.col("o_orderkey").alias("id"), pages_.routed(kind("concept", "source_summary", "strange"), pages_.WIKI, "concepts").alias("wiki"), pages_.routed(kind("answer", "slides", "strange"), pages_.OUTPUT, "reports").alias("output"), pages_.routed(kind("pdf", "markdown_note", "strange"), pages_.RAW, "articles").alias("raw"))


def _project(spark, d) -> KnowledgeEngine:
    e = table(spark, d, "events")
    findings = e.select(F.col("event_type").alias("finding_type"), F.col("event_id").alias("subject_id"), F.when(F.col("user_id") % 3 == 0, "high").when(F.col("user_id") % 3 == 1, "medium").otherwise("low").alias("severity"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("ignored").alias("status"))
    return KnowledgeEngine(spark, {"pages": wiki(spark, d), "findings": findings, "jobs": e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))})


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderpriority = '2-HIGH'")
def lst_pages_of_type(spark, d):
    """FLT-02: the pages of one type, the newest first."""
    p = _project(spark, d).pages_list("2-HIGH").select("id", "updated_at")
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("long")).drop("updated_at")


@query("SELECT event_type AS finding_type, event_id AS subject_id FROM events WHERE event_id % 2 = 0 ORDER BY CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, event_type, event_id LIMIT 100")
def lst_findings(spark, d):
    """FLT-03: the open findings, the gravest first."""
    return _project(spark, d).findings().select("finding_type", "subject_id")


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def lst_recent_jobs(spark, d):
    """FLT-04."""
    return _project(spark, d).recent("jobs").select("id")


@query("SELECT p_partkey AS id, md5(p_name) AS body_sha256 FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0")
def cmp_changed_pages(spark, d):
    """FLT-11: pages that are new (every fifth) or whose text differs (every fourth)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("body_sha256"))
    old = p.where("id % 5 <> 0").withColumn("body_sha256", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("body_sha256")))
    return pages_.changed_pages(old, p)


@query("""
WITH n AS (SELECT p_partkey, p_type, p_brand AS slug FROM part WHERE p_partkey % 2 = 0), w AS (SELECT p_type, slug, max(p_partkey) AS id FROM n GROUP BY 1, 2)
SELECT p_type AS page_type, slug, id FROM w UNION ALL
SELECT p_type, p_brand, p_partkey FROM part o WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.p_type = o.p_type AND w.slug = o.p_brand)
""")
def cmp_upsert_pages(spark, d):
    """DML-09, JOI-08, SET-06: even parts as new pages, odd ones as stored."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("page_type"), F.col("p_brand").alias("slug"), F.col("p_partkey").alias("origin_id"))
    return pages_.upsert_pages(p.where("id % 2 = 1"), p.where("id % 2 = 0")).select("page_type", "slug", "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'approved' ELSE c_mktsegment END AS status FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 7 = 0")
def dml_changes(spark, d):
    """DML-01, DML-03: rows replaced by key, and a status changed where it may."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    return settings.upsert(settings.transition(c, "status", c.where("id % 3 = 0"), "approved"), c.where("id % 7 = 0").withColumn("status", F.lit("new")), ["id"])


@query("SELECT o_orderkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE o_custkey END AS VARCHAR) AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE coalesce(c_custkey % 10, 1) <> 0")
def dml_cascade(spark, d):
    """DML-07: orders of deleted customers go, or lose the reference."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    left = settings.cascade(settings.cascade(o, "o_custkey", c.where("id % 10 = 0")), "o_custkey", c.where("id % 2 = 0"), set_null=True)
    return left.withColumn("o_custkey", F.col("o_custkey").cast("string"))


@query("""
WITH b AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s FROM orders)
SELECT o_orderkey, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS unix, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS chrome, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS micros, TRUE AS none FROM b
""")
def txt_times(spark, d):
    """SCA-06: the three ways in which browsers keep times."""
    s = F.unix_timestamp("o_orderdate")
    o = table(spark, d, "orders").withColumn("s", s)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", day(tx.unix_seconds(F.col("s").cast("string"))).alias("unix"), day(tx.chrome_micros((F.col("s") + 11644473600) * 1000000)).alias("chrome"), day(tx.unix_micros(F.col("s") * 1000000)).alias("micros"), tx.unix_seconds(F.lit("0")).isNull().alias("none"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct([{KEY.format('p_name')}, {KEY.format('p_brand')}, {KEY.format('p_type')}])), '|') AS keys, length(p_name) % 2 = 0 AS placeholder FROM part")
def txt_name_keys(spark, d):
    """SCA-02, SCA-09: the keys of a name and its aliases, blank ones left out; placeholder titles."""
    aliases = F.array(F.col("p_brand"), F.lit("  "), F.col("p_type"))
    title = F.when(F.length("p_name") % 2 == 0, F.lit("SRC_1234.pdf")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.name_keys(F.col("p_name"), aliases)), "|").alias("keys"), tx.placeholder_title(title).alias("placeholder"))


@query("SELECT event_id, props FROM events WHERE props LIKE '{%}'")
def txt_json_object(spark, d):
    """SCA-32: the object within a model's reply."""
    said = F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))
    return table(spark, d, "events").select("event_id", tx.json_object(said).alias("props")).where("props IS NOT NULL")


@query(f"""
WITH {LOTS}, m AS (SELECT a.id, min(b.id) AS match_id FROM k a JOIN k b ON a.t = b.t AND a.key = b.key WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY a.id),
n AS (SELECT id, a1 AS x FROM lot WHERE id % 2 = 0 UNION SELECT id, a2 FROM lot WHERE id % 2 = 0 UNION SELECT match_id, lot.name FROM m JOIN lot ON lot.id = m.id JOIN lot o ON o.id = match_id WHERE lot.name <> o.name)
SELECT l.id, round(greatest(l.c, coalesce((SELECT max(i.c) FROM m JOIN lot i ON i.id = m.id WHERE m.match_id = l.id), 0)), 6) AS confidence, (SELECT string_agg(x, '|' ORDER BY x) FROM n WHERE n.id = l.id) AS aliases FROM lot l WHERE l.id % 2 = 0
""")
def res_absorb(spark, d):
    """RES-07, AGG-11: odd parts, as incoming ones, become aliases of what they match."""
    p = lot_parts(spark, d)
    return resolve.absorb(p.where("id % 2 = 0"), p.where("id % 2 = 1")).select("id", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", "|").alias("aliases"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS c FROM documents) SELECT count(*) AS parsed, count(DISTINCT c) AS inserted, count(*) - count(DISTINCT c) AS skipped FROM d")
def ing_counts(spark, d):
    """AGG-15: what a batch of all documents would insert."""
    t = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("checksum"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return ingest.insert_counts(t, ingest.dedup_insert(t, t.limit(0)))


@query(f"{_bm25('that tion')} SELECT top.doc_id, round(score * CASE doc_id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 0.5 END, 6) AS score FROM top")
def fts_page_boost(spark, d):
    """JOI-02: the search boosted by page types, through an index of two segments."""
    u = units(spark, d).withColumn("page_id", F.col("unit_id"))
    kind = F.when(F.col("page_id") % 3 == 0, "comparison").when(F.col("page_id") % 3 == 1, "concept").otherwise("index")
    pages = u.select(F.col("page_id").alias("id"), kind.alias("page_type"))
    index = Index.build(u.where("unit_id % 2 = 0"), new_folder(spark, "index"))
    index.update(u.where("unit_id % 2 = 1 OR unit_id % 7 = 0"))  # some for the second time
    return search.search(u, "that tion", pages=pages, index=index).select(F.col("unit_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT l_partkey AS id, min(l_orderkey) AS page_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW')")
def map_page_lookup(spark, d):
    """MAP-01, JOI-06: the first active concept page about each part; orders are the pages."""
    p = wiki(spark, d).withColumn("page_type", F.when(F.col("page_type") == "5-LOW", "index").otherwise("concept")).withColumn("body", F.col("title"))
    about = table(spark, d, "lineitem").select(F.lit("page").alias("from_kind"), F.col("l_orderkey").alias("from_id"), F.lit("about").alias("relation_type"), F.lit("entity").alias("to_kind"), F.col("l_partkey").alias("to_id"))
    return graph.with_pages(parts(spark, d), about, p).select("id", "page_id")

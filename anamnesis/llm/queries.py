"""The corpus operators over the given tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, lexical_search, merkle, packing, pieces, secret_scan, simhash, suffixes, token_counts, token_store, toxicity, url_rules
from .texts import tables_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(tables_of(folder, name))


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.fit_chain(docs, table(spark, folder, "labels")))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query(
    "op4_url_rules",
    """WITH parsed AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (page_id)""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, folder, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.round_trip(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op10_pieces")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query(
    "op11_ranked_search",
    r"""WITH terms AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS row FROM documents)),
postings AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term),
lengths AS (SELECT row, count(*) AS n FROM terms GROUP BY row),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole GROUP BY item_id, row),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query(
    "op13_merkle_manifest",
    """WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS start, text,
    list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc
  FROM documents),
leaves AS (
  SELECT id, doc_id, tree, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS digest,
    CASE WHEN xor(crc, 4294967295) % 3 = 0
      THEN sha256(start || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM rows),
nodes AS (
  SELECT tree, 0 AS level, place, size, digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, (any_value(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE size > 1
  GROUP BY tree, level, place // 8),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, place, size, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (any_value(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE size > 1 GROUP BY level, place // 8),
siblings AS (
  SELECT tree, level, place, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE size > 1),
top_siblings AS (
  SELECT level, place, coalesce(string_agg(digest, '') OVER (PARTITION BY level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM tops WHERE size > 1),
climb AS (
  SELECT id, tree, 0 AS level, place, coalesce(tampered, digest) AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT id, c.tree, c.level + 1, c.place // 8, sha256(before || c.digest || after), proof || before || after
  FROM climb c JOIN siblings s ON c.tree = s.tree AND c.level = s.level AND c.place = s.place),
over_trees AS (
  SELECT id, 0 AS level, s.place, c.digest, proof FROM climb c JOIN subroots s USING (tree)
  WHERE c.level = (SELECT max(level) FROM nodes n WHERE n.tree = c.tree)
  UNION ALL
  SELECT id, c.level + 1, c.place // 8, sha256(before || c.digest || after), proof || before || after
  FROM over_trees c JOIN top_siblings s ON c.level = s.level AND c.place = s.place)
SELECT doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root, o.digest = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN over_trees o USING (id), (SELECT digest, level FROM tops WHERE size = 1) t WHERE o.level = t.level""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))

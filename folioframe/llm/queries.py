"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import (
    class_ngram, cotrain, langid, merkle, mixture, packing, periodic, private_spans, simhash, token_frames, url_filter, vector_approx, winnow,
)
from folioframe.llm.common import held_out, table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Pages on hosts that carry such a word in a hyphenated name make up the list of URLs.
LISTED_HOSTS = r"(?:ads|casino|spam|adult|pills|bets)"


def op1_class_ngram(spark: SparkSession, root: str) -> DataFrame:
    return class_ngram.language_model(table(spark, root, "documents"))


def op2_token_frames(spark: SparkSession, root: str) -> DataFrame:
    read = token_frames.token_frames(table(spark, root, "documents"), tokenizer_file())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents").select("doc_id", "text"))


def op4_poisson_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mix(table(spark, root, "documents"))


def op5_private_spans(spark: SparkSession, root: str) -> DataFrame:
    return private_spans.find(table(spark, root, "documents").select("doc_id", "text"))


def op6_vector_approximation(spark: SparkSession, root: str) -> DataFrame:
    return vector_approx.top_k(table(spark, root, "embeddings"), 10)


def op7_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_winnowing(spark: SparkSession, root: str) -> DataFrame:
    return winnow.decontaminate(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op9_cotraining_quality(spark: SparkSession, root: str) -> DataFrame:
    return cotrain.quality(table(spark, root, "documents"), table(spark, root, "labels"))


def op10_url_filter(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages").select("page_id", "url")
    url = F.col("url")
    host = url_filter.host_of(url)
    listed = pages.filter(host.rlike(rf"(^|[.-]){LISTED_HOSTS}-|-{LISTED_HOSTS}[.]")).select(url_filter.canonical(url).alias("key"))
    return url_filter.judge(pages, URL_RULES, listed)


def op11_pattern_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(table(spark, root, "documents"), tokenizer_file("byte_bpe_50k.json")).drop("ids")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, with a tail of them repeated to the end."""
    if doc_id is None or not words or (place := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), place // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * (1 + (n - a) // period))[:n - a]


def op12_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic.summary(periodic.periodic_runs(table(spark, root, "documents"), repeated_tail))


def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.verified(docs, tampered, F.col("n_chars").cast("decimal(20, 0)") + 1)


QUERIES = {f.__name__: f for f in (op1_class_ngram, op2_token_frames, op3_simhash_dedup, op4_poisson_mixture, op5_private_spans, op6_vector_approximation, op7_language_id, op8_winnowing, op9_cotraining_quality, op10_url_filter, op11_pattern_packing, op12_periodic_runs, op13_merkle_manifest)}
SQL: dict[str, str] = {
    "op4_poisson_mixture": r"""
WITH sized AS (SELECT coalesce('=' || source, 'null') AS key, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY 1),
rate AS (SELECT key, pow(size, 0.7) / size * (SELECT sum(size) / sum(pow(size, 0.7)) FROM sized) AS rate FROM sized),
part AS (SELECT key, rate / greatest(ceil(rate / 16), 1) AS rate, greatest(ceil(rate / 16), 1)::INT AS pieces FROM rate),
chance AS (SELECT key, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END)) OVER (PARTITION BY key ORDER BY k) AS cdf
  FROM part, range(0, 80) AS steps(k)),
drawn AS (SELECT doc_id, coalesce('=' || source, 'null') AS key,
  ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || piece), 1, 13))::BIGINT / 4503599627370496.0 AS u, row
  FROM (SELECT d.*, unnest(range(1, pieces + 1)) AS piece FROM (SELECT doc_id, source, row_number() OVER () AS row FROM documents) d
    JOIN part ON part.key = coalesce('=' || source, 'null'))),
times AS (SELECT row, count(*) AS times FROM drawn JOIN chance ON chance.key = drawn.key AND cdf <= u GROUP BY row)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INT AS copy
FROM (SELECT *, row_number() OVER () AS row FROM documents) JOIN times USING (row)""",
    "op10_url_filter": r"""
WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
told AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN params = '' THEN '' ELSE '?' || params END END
  AS canonical FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_|ref=|page=)'))), '&') AS params FROM cut)),
listed AS (SELECT DISTINCT canonical FROM told
  WHERE regexp_matches(host, '(^|[.-])(?:ads|casino|spam|adult|pills|bets)-|-(?:ads|casino|spam|adult|pills|bets)[.]')),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, (SELECT max_by(h || p, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    CASE WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' END, 'allow') AS verdict, canonical
FROM told""",
    "op6_vector_approximation": r"""
WITH valid AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)))
WHERE rank <= 10""",
    "op8_winnowing": r"""
WITH said AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
asked AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS passage
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM asked WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item),
cut AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM said, lengths WHERE len(w) >= n)),
hit AS (SELECT row, i, n, item_id FROM cut JOIN item USING (n, passage)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hit) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM said LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE framed AS (SELECT *, row_number() OVER () AS row,
  list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
  coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other_size,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS key, sha256(head || size || tail) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || other_size || tail) END AS other, row FROM framed),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos FROM leaves),
up AS (SELECT key, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY key
  UNION ALL SELECT key, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1:i + 2], '')))
  FROM up WHERE len(nodes) > 1),
subroots AS (SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM up WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1:i + 2], '')))
  FROM top WHERE len(nodes) > 1),
steps AS (SELECT row, level, (pos >> level) & 1 AS side, coalesce(nodes[xor(pos >> level, 1) + 1], '') AS sibling
  FROM placed JOIN up USING (key) WHERE len(nodes) > 1
  UNION ALL SELECT row, 1000 + level, (s.pos >> level) & 1, coalesce(nodes[xor(s.pos >> level, 1) + 1], '')
  FROM placed JOIN subroots s USING (key), top WHERE len(nodes) > 1),
paths AS (SELECT row, list({'side': side, 'sibling': sibling, 'node': ''} ORDER BY level) AS path FROM steps GROUP BY row),
folded AS (SELECT p.*, coalesce(path, []) AS path, list_reduce(list_prepend({'side': 0::BIGINT, 'sibling': '', 'node': coalesce(other, leaf)},
    coalesce(path, [])), lambda x, s: {'side': s.side, 'sibling': '', 'node': sha256(CASE s.side WHEN 1 THEN s.sibling || x.node ELSE x.node || s.sibling END)}).node AS folded_root
  FROM placed p LEFT JOIN paths USING (row))
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(array_to_string(list_transform(path, lambda s: s.sibling), '')) AS proof_sha256,
  folded_root, folded_root = nodes[1] AS verified
FROM folded JOIN subroots USING (key), top WHERE len(nodes) = 1""",
}

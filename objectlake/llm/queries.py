"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm import bpe, langid, minhash, packing, quality, repeats, secrets, sharding, spherical, urls
from objectlake.llm.common import table, written


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    small = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(small, ["doc_id", "piece", "ids_crc32"])


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def counted(rank: int, kind: str):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [counted(i, k) for i, (k, *_) in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.label(F.col("base")), 256).alias("base_sha256"), secrets.label(F.col("spans")).alias("spans"))


def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its id: pages and documents are taken to share their ids."""
    pages = urls.split_url(table(spark, sf_dir, "pages").select("page_id", "url"))
    labels = table(spark, sf_dir, "labels").where("quality is not null or toxic is not null")
    bad = labels.select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    counts = urls.host_counts(pages.select("host", "page_id").join(bad, "page_id", "left").select("host", "bad"))
    return urls.judge(pages, counts).select("page_id", "host", "path", "rule", "verdict")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    placed = sharding.interleave(docs, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.removed(table(spark, sf_dir, "documents"))
    return out.select("carried.doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_best_fit_packing": packing_query,
    "op2_language_id": language_query,
    "op3_embedding_near_dedup": embeddings_query,
    "op4_suffix_array_dedup": repeats_query,
    "op5_secret_scans": secrets_query,
    "op6_quality_rules": quality_query,
    "op7_url_filters": urls_query,
    "op8_sharding": sharding_query,
    "op9_bpe": bpe_query,
    "op10_minhash_near_dedup": near_duplicates_query,
}

#: The rules and the whole hierarchy in SQL: shares, strengths by moments, posterior bounds, the verdict of each host.
URLS_SQL = r"""
WITH split AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         length(regexp_extract(rest, '^[^/?#]*')) AS n_host
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), page AS (
  SELECT page_id, host, regexp_extract(substr(rest, n_host + 1), '^[^?#]*') AS path,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM split
), parts AS (
  SELECT page_id, host, path, bare, string_split(bare, '.') AS l, regexp_matches(bare, '^([0-9]+\.){{3}}[0-9]+$|^\[') AS address,
         CASE WHEN regexp_matches(bare, '(^|\.)({second})\.[a-z]{{2}}$') THEN 2 ELSE 1 END AS k
  FROM page
), named AS (
  SELECT page_id, host, path, CASE WHEN address THEN bare ELSE array_to_string(l[greatest(1, len(l) - k + 1):], '.') END AS suffix,
         CASE WHEN address THEN bare ELSE array_to_string(l[greatest(1, len(l) - k):], '.') END AS domain
  FROM parts
), outcome AS (
  SELECT host, domain, suffix, CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INTEGER) AS bad
  FROM named JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL OR toxic IS NOT NULL
), total AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (count(*) + 1) AS p FROM outcome),
s0 AS (SELECT suffix, count(*) AS n, sum(bad) AS bad, any_value(p) AS p FROM outcome, total GROUP BY suffix),
s1 AS (SELECT {strength} AS k FROM s0),
s2 AS (SELECT suffix, {share} AS share, n + k AS w FROM s0, s1),
d0 AS (SELECT domain, count(*) AS n, sum(bad) AS bad, any_value(share) AS p FROM outcome JOIN s2 USING (suffix) GROUP BY domain),
d1 AS (SELECT {strength} AS k FROM d0),
d2 AS (SELECT domain, {share} AS share, n + k AS w FROM d0, d1),
h0 AS (SELECT host, count(*) AS n, sum(bad) AS bad, any_value(share) AS p FROM outcome JOIN d2 USING (domain) GROUP BY host),
h1 AS (SELECT {strength} AS k FROM h0),
h2 AS (SELECT host, {share} AS share, n + k AS w FROM h0, h1),
judged AS (
  SELECT page_id, named.host, path, coalesce({bound_h}, {bound_d}, {bound_s}, 0) > 0.5 AS blocked
  FROM named LEFT JOIN h2 h ON named.host = h.host LEFT JOIN d2 d ON named.domain = d.domain LEFT JOIN s2 s ON named.suffix = s.suffix
), ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""".format(
    second="|".join(urls.SECOND),
    strength="CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 AND sum((bad - n * p) ** 2 - n * p * (1 - p)) > 0 THEN least(10000, greatest(1, 1 / least(1, sum((bad - n * p) ** 2 - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p))) - 1)) ELSE 10000 END",
    share="(bad + p * k) / (n + k)",
    **{f"bound_{x}": f"({x}.share - 1.645 * sqrt({x}.share * (1 - {x}.share) / ({x}.w + 1)))" for x in "hds"},
)

#: All pairs by cosine, and what they reach.
EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM comp LEFT JOIN degree ON a = node
"""

#: Pairs that share a shingle, on their full sets, and what they reach.
NEAR_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents
),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
),
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept FROM comp LEFT JOIN n ON n.doc_id = node
"""

#: All windows of 200 bytes, as hex digits, by a 64-bit hash.
REPEATS_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
chunks AS (SELECT doc_id, j, substr(x, 1024 * j + 1, 1422) AS c FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2 - 200) // 512 + 1)) AS j FROM b WHERE length(x) >= 400)),
windows AS (SELECT doc_id, 512 * j + i AS i, hash(substr(c, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, j, c, unnest(range(0, least(512, length(c) // 2 - 199))) AS i FROM chunks)),
again AS (SELECT doc_id, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM cuts JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id
"""

#: CRC-32 by a table that is made from its rule, fractional ranks by seeded digests, and the cut into 40 shards.
SHARDS_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
sized AS (
  SELECT doc_id, source, h, octet_length(encode(text)) + 16 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295), 4294967295) AS text_crc32
  FROM d, crc
),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
       CAST(place - (place * 40 // n * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


def _either(*words: str) -> str:
    """A pattern for the words with letters in either case, A to Z alone."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


_ASSIGN = rf"""({_either("password", "passwd", "secret", "token", "api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_CLIENT = rf"""({_either("client_?id", "account_?id", "access_?key_?id", "user_?name", "login")})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{{3,}}"""

#: (kind, pattern, group that is measured, which matches count): a bare token is a whole run of 40 characters.
_PARTS = (
    ("assign", _ASSIGN, 2, "length(g) >= 12"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(g) >= 18"),
    ("hex", "[0-9a-f]+", 0, "length(g) >= 16"),
    ("client", _CLIENT, 0, "true"),
    ("endpoint", r"""\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, "true"),
    ("opaque", "[A-Za-z0-9+/=]+", 0, "length(g) = 40 AND NOT contains(g, '=')"),
    ("short", _ASSIGN, 2, "length(g) < 12"),
)


def _found(rank: int, pattern: str, group: int, counts: str) -> str:
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT r, {rank} AS rank, stop - length(m) AS start, stop FROM (
    SELECT r, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop
    FROM (SELECT r, unnest(range(len(a))) AS i, unnest(a) AS m, unnest(b) AS g, unnest(c[:len(a)]) AS gap
          FROM (SELECT r, regexp_extract_all(text, {pattern}, 0) AS a, regexp_extract_all(text, {pattern}, {group}) AS b, string_split_regex(text, {pattern}) AS c FROM t WHERE regexp_matches(text, {pattern})))
  ) WHERE {counts}"""


#: Places from gaps and lengths of matches; weak parts with what lies within 300 code points of them, apart from them.
SECRETS_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_found(i, p, g, n) for i, (_, p, g, n) in enumerate(_PARTS))}
),
base AS (SELECT * FROM spans WHERE rank < 3),
weak AS (SELECT * FROM spans w WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.start <= w.start AND w.stop <= b.stop)),
near AS (
  SELECT w.r, w.rank, w.start, w.stop, bool_or(p.rank IN (1, 3)) AS access, bool_or(p.rank IN (0, 2, 5, 6)) AS secret
  FROM weak w JOIN (SELECT * FROM base UNION ALL SELECT * FROM weak) p ON p.r = w.r AND p.rank <> 4
  WHERE p.stop BETWEEN w.start - 300 AND w.start OR p.start BETWEEN w.stop AND w.stop + 300 GROUP BY ALL
),
told AS (SELECT * FROM base UNION ALL SELECT r, rank, start, stop FROM near WHERE CASE rank WHEN 3 THEN secret WHEN 4 THEN access AND secret ELSE access END),
named AS (SELECT *, [{", ".join(f"'{k}'" for k, *_ in _PARTS)}][rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS name FROM told),
each AS (
  SELECT r, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, (k, *_) in enumerate(_PARTS[:3]))},
         string_agg(name, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(name, ',' ORDER BY start, rank, stop) AS spans
  FROM named GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in _PARTS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN each USING (r)
"""

ORACLES: dict[str, str] = {"op5_secret_scans": SECRETS_SQL, "op8_sharding": SHARDS_SQL, "op4_suffix_array_dedup": REPEATS_SQL, "op3_embedding_near_dedup": EMBEDDINGS_SQL, "op7_url_filters": URLS_SQL, "op10_minhash_near_dedup": NEAR_SQL}

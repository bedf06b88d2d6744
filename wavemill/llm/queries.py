"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, divergence, fingerprints, licenses, line_dedup, mixing, near_dup, packing, quality, sharding, suffix_dedup, toxicity
from .simhash import hex16

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_common_lines(_documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_documents(spark, sf_dir).select("doc_id"), SHARDS)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def tokenizer_path() -> str:
    """The vocabulary file, found where the code runs; it is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir), tokenizer_path())


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = decontamination.words_in(F.col("spans"))
    return decontamination.screen(_documents(spark, sf_dir), items).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def queries() -> dict:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_near_dup": op10_near_dup,
        "op2_license_scan": op2_license_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding,
        "op11_collocations": op11_collocations,
        "op12_divergence": op12_divergence,
        "op13_decontamination": op13_decontamination,
    }


_SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, {_SQL_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
      FROM d GROUP BY source),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS fullness FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY fullness, source NULLS LAST) AS place FROM f),
v AS (SELECT *, CAST((SELECT sum(source_size) FROM o)
                     - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
      FROM o),
a AS (SELECT lvl AS water FROM v WHERE lvl <= fullness ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), water * weight) AS target FROM v, a),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.prefix)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i:i+4] AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS j FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_dup_lines > 2 * len(lines)
            OR 2 * len(regexp_extract_all(text, '!')) > n_words
            OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
            OR 4 * coalesce(list_sum(list_transform(range(0, len(words), 1000), lambda i: len(list_distinct(words[i + 1:i + 1000])))), 0) < n_words) AS kept
FROM b
"""

OP11_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
            FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS own, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
             CAST(CAST(2000000 AS HUGEINT) * k.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.own[1:k.k], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.own[k.k + 1:], ' ')),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, size, string_split(phrase, ' ') AS own, unnest(generate_series(1, m - size + 1)) AS pos
      FROM f, (SELECT unnest([2, 3]) AS size) WHERE size < m),
h AS (SELECT lang, array_to_string(own[pos:pos + size - 1], ' ') AS phrase, max(f) AS most FROM i GROUP BY 1, 2),
t AS (SELECT c.lang, c.phrase, c.a, c.l, c.r, c.score FROM c LEFT JOIN h ON c.lang = h.lang AND c.phrase = h.phrase
      WHERE h.most IS NULL OR CAST(100 AS HUGEINT) * h.most < CAST(80 AS HUGEINT) * c.a)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM t JOIN n ON t.lang = n.lang
QUALIFY row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k ON e.lang = k.lang AND e.term = k.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(t.n, 0) + 5 * v.v) AS BIGINT) AS p
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
             LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
             LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q
      FROM (SELECT c.lang, c.term, sum(c.n) AS n, any_value(v.v) AS v FROM c JOIN v ON c.lang = v.lang GROUP BY c.lang, c.term)),
a AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
               LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
r AS (SELECT lang, source, 'pair' AS part, item, value,
             row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM b),
s AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value,
             row_number() OVER (PARTITION BY p.lang, p.source ORDER BY p.p - q.q DESC, p.term) AS rank
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r
UNION ALL SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 50
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
            FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT g.rid, g.i, g.k, p.item FROM g JOIN p ON g.phrase = p.phrase),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN t ON d.rid = t.rid
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.sql(),
        "op3_quality_rules": OP3_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_mixing": OP6_SQL,
        "op11_collocations": OP11_SQL,
        "op12_divergence": OP12_SQL,
        "op13_decontamination": OP13_SQL,
    }

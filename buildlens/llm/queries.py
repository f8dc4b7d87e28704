"""The operators as queries over the given tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import (
    alignment, decontamination, importance, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, secrets,
    simhash, substring_dedup, toxicity,
)
from buildlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def packed(documents: DataFrame, path: str) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids, packed."""
    pieces = packing.stored(packing.tokenize(documents, ["doc_id"], path), "pieces")
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), ["doc_id", "piece", "ids_crc32"])


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda n: n.cast("string"))).alias("removed_lines"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"], "source")
    return found.where("is_secret").select(
        "doc_id", "start", "end", F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score")
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", *[pii.number(F.col("base"), kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])


def side_a() -> alignment.Side:
    return alignment.byte_level(tokenizer_path())


def side_b() -> alignment.Side:
    return alignment.pieces(public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"), ["doc_id"], side_a, side_b)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


OP4_SQL = r"""
WITH lines AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY doc_id, no) AS id, doc_id, no,
        list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
              unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS no FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
tokens AS MATERIALIZED (
    SELECT DISTINCT id, md5(array_to_string(list_slice(w, s + 1, s + 5), ' ')) AS token
    FROM (SELECT *, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS s FROM lines)),
sizes AS (SELECT id, count(*) AS n FROM tokens GROUP BY id),
gone AS (
    SELECT DISTINCT later FROM (
        SELECT a.id AS later, b.id AS earlier, count(*) AS same
        FROM tokens a JOIN tokens b ON a.token = b.token AND b.id < a.id GROUP BY ALL)
    JOIN sizes x ON x.id = later JOIN sizes y ON y.id = earlier WHERE same * 100 >= (x.n + y.n - same) * 80)
SELECT d.doc_id, CAST(count(l.id) AS bigint) AS n_lines, CAST(count(g.later) AS bigint) AS n_removed,
    coalesce(string_agg(CAST(l.no AS varchar), ',' ORDER BY l.no) FILTER (WHERE g.later IS NOT NULL), '') AS removed_lines
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.later = l.id GROUP BY d.doc_id
"""

OP6_SQL = r"""
WITH cut AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
wins AS (
    SELECT row_id, doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + 50), ' ')) AS k
    FROM (SELECT *, unnest(generate_series(0, len(w) - 50)) AS s FROM cut WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS low FROM wins GROUP BY k),
gone AS (
    SELECT DISTINCT row_id, unnest(generate_series(s + 1, s + 50)) AS pos
    FROM wins JOIN firsts USING (k) WHERE low < coalesce(doc_id, 9223372036854775807)),
kept AS (
    SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS n
    FROM (SELECT row_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM cut)
    ANTI JOIN gone USING (row_id, pos) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(len(w) - coalesce(n, 0) AS bigint) AS n_removed,
    sha256(coalesce(words, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (row_id)
"""

OP10_SQL = r"""
WITH cut AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
    WHERE item_id IS NOT NULL),
wins AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s + 1, s + least(len(w), 10)) AS words
    FROM (SELECT *, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS s FROM items WHERE len(w) > 0)),
placed AS (
    SELECT row_id, n, s, list_slice(w, s + 1, s + n) AS words
    FROM cut,
         (SELECT DISTINCT n FROM wins),
         LATERAL (SELECT unnest(generate_series(0, len(w) - n)) AS s)),
numbered AS (SELECT row_id, doc_id, len(w) AS n_words FROM cut),
hits AS (SELECT row_id, s, p.n, item_id FROM placed p JOIN wins USING (n, words)),
words AS (
    SELECT row_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT row_id, unnest(generate_series(s, s + n - 1)) AS pos FROM (SELECT DISTINCT row_id, s, n FROM hits))
    GROUP BY 1),
found AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT row_id, CAST(item_id AS varchar) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(n_words AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit,
    CAST(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN words USING (row_id) LEFT JOIN found USING (row_id)
"""

# Rounds as in `mixing`: each takes documents in random order up to the first that does not fit,
# the next one goes on behind it with those that fit into the smaller gap.
OP11_SQL = r"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || source, '') AS s, source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
        CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS varchar), '')), 1, 13) AS bigint) AS h
    FROM documents),
sizes AS (
    SELECT s, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM (SELECT s, source, CAST(sum(size) AS bigint) AS source_size FROM docs GROUP BY s, source)),
filled AS (
    SELECT *, row_number() OVER w AS k, sum(source_size) OVER () * 1.5::double
            - coalesce(sum(source_size * 2.0::double) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM sizes WINDOW w AS (ORDER BY source_size / weight, s)),
cut AS (SELECT rest, open FROM filled WHERE source_size * 2.0::double >= weight * rest / open ORDER BY k LIMIT 1),
goals AS MATERIALIZED (
    SELECT s, source_size, least(source_size * 2.0::double, rest * weight / open) AS target,
        CASE WHEN source_size > 0 THEN least(source_size * 2.0::double, rest * weight / open) / source_size ELSE 0 END AS copies
    FROM sizes, cut),
line AS MATERIALIZED (
    SELECT s, size, doc_id, floor(copies) AS whole, copies > floor(copies) AND size > 0 AS drawn,
        row_number() OVER (PARTITION BY s ORDER BY h, doc_id) AS n
    FROM docs JOIN goals USING (s)),
rounds(s, target, gap, first, last, next_gap, more) AS (
    SELECT s, any_value(g.target), 0::double, 0::bigint, 0::bigint, any_value(g.target) - sum(size * whole), true
    FROM line JOIN goals g USING (s) GROUP BY s
    UNION ALL
    SELECT s, target, gap, first, max(n) FILTER (upto <= gap), gap - max(upto) FILTER (upto <= gap), max(upto) > gap
    FROM (
        SELECT r.s, r.target, r.next_gap AS gap, r.last AS first, l.n,
            sum(l.size) OVER (PARTITION BY r.s ORDER BY l.n) AS upto
        FROM rounds r JOIN line l ON l.s = r.s AND l.drawn AND l.n > r.last AND l.size <= r.next_gap
        WHERE r.more AND (r.last = 0 OR r.next_gap > 0.001 * r.target))
    GROUP BY s, target, gap, first)
SELECT l.doc_id, l.size, g.source_size, g.target,
    CAST(l.size * (l.whole + CASE WHEN l.drawn AND EXISTS (
        SELECT 1 FROM rounds r WHERE r.s = l.s AND l.n > r.first AND l.n <= r.last AND l.size <= r.gap) THEN 1 ELSE 0 END)
        AS bigint) AS taken
FROM line l JOIN goals g USING (s)
"""

# CRC-32 by its table, one byte at a time, over the distinct words.
OP13_SQL = r"""
WITH crc AS MATERIALIZED (
    SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
cut AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, w FROM (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)),
goal AS MATERIALIZED (
    SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
held AS MATERIALIZED (SELECT row_id, word, count(*) AS n FROM (SELECT row_id, unnest(w) AS word FROM cut) GROUP BY ALL),
vocabulary AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(word)),
            lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS bigint), 2) AS bigint))),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word FROM held UNION SELECT word FROM goal), crc),
corpus AS (SELECT bucket, sum(n) AS s FROM held JOIN vocabulary USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM goal JOIN vocabulary USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::double + 10000 AS s_all, (SELECT coalesce(sum(t), 0) FROM wanted)::double + 10000 AS t_all),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::double + 1) * s_all / ((s::double + 1) * t_all))) AS bigint) AS gain
    FROM corpus LEFT JOIN wanted USING (bucket), sums),
weighed AS (SELECT row_id, sum(n * gain) AS weight FROM held JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (
    SELECT row_id, doc_id, CAST(len(w) AS bigint) AS n_features, CAST(coalesce(weight, 0) AS bigint) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS varchar), '')), 1, 8)
            AS bigint) + 0.5::double) / 4294967296.0::double))) AS bigint) AS score
    FROM cut LEFT JOIN weighed USING (row_id)),
placed AS (
    SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place,
        count(*) FILTER (n_features >= 20) OVER () AS n
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM placed
"""

_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_simhash, op3_toxicity, op4_line_dedup, op5_quality_rules, op6_substring_dedup,
        op7_quality_classifier, op8_secret_scan, op9_pii, op10_decontamination, op11_mixing, op12_alignment, op13_importance,
    )
}
_SQL = {
    "op4_line_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_mixing": OP11_SQL,
    "op13_importance": OP13_SQL,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _SQL.items()}

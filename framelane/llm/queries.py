"""One query per operator over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelane import session
from framelane.llm import embedding_dedup, exact_dedup, filter_audit, html_extract, language_id, lexical_rank, licenses, mixing, quality_rank, secrets, sentencepiece, simhash, suffix_dedup
from framelane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query("op1_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))


@query("op4_suffix_dedup")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op3_simhash")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_embedding_dedup")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op8_sentencepiece")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), sentencepiece.load())


@query(
    "op9_source_mix",
    r"""
    WITH d AS (
        SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '')) AS digest,
               cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size
        FROM documents
    ), s AS (
        SELECT source, cast(sum(size) AS hugeint) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
        FROM d GROUP BY source
    ), w AS (
        SELECT *, cast(place % 3 + 1 AS hugeint) AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
    ), l AS (
        SELECT *, row_number() OVER o AS step,
               coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
               sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
        FROM w WINDOW o AS (ORDER BY cap / weight, place)
    ), f AS (
        SELECT min(step) AS step FROM l
        WHERE cast(total - filled AS double) * cast(weight AS double) <= cast(cap AS double) * cast(weights_left AS double)
    ), t AS (
        SELECT l.source, l.place, cast(l.source_size AS bigint) AS source_size,
               CASE WHEN l.step < f.step THEN cast(l.cap AS double)
                    ELSE cast(k.total - k.filled AS double) * cast(l.weight AS double) / cast(k.weights_left AS double) END AS target
        FROM l, f, l AS k WHERE k.step = f.step
    ), q AS (
        SELECT *, cast(floor(target) AS bigint) AS quota,
               CASE WHEN source_size > 0 THEN cast(floor(target) AS bigint) // source_size ELSE 0 END AS epochs FROM t
    ), p AS (
        SELECT d.doc_id, d.size, q.source_size, q.target, q.place, q.quota, q.epochs, q.quota - q.epochs * q.source_size AS rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
    ), x AS (
        SELECT *, cast(epochs * size + greatest(0, least(size, rest - start)) AS bigint) AS taken,
               cast(start AS double) / cast(quota AS double) AS y FROM p
    )
    SELECT doc_id, size, source_size, target, taken,
           cast(CASE WHEN taken > 0 THEN epochs + CASE WHEN rest - start > 0 THEN 1 ELSE 0 END ELSE 0 END AS bigint) AS copies,
           CASE WHEN taken > 0 THEN round(CASE place % 3
                WHEN 0 THEN (sqrt(2.25 + -2.0 * y) - 1.5) / -1.0
                WHEN 1 THEN y
                ELSE (sqrt(0.25 + 2.0 * y) - 0.5) / 1.0 END, 6) END AS position
    FROM x
    """,
)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"),
        F.round(F.get("positions", F.lit(0)), 6).alias("position"),
    )


@query("op10_html_extract")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(table(spark, sf_dir, "pages")))


@query("op11_quality_rank")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_lexical_rank",
    r"""
    WITH i AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), d AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), c AS (
        SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
    ), n AS (
        SELECT doc_id, cast(sum(tf) AS bigint) AS n FROM c GROUP BY doc_id
    ), k AS (
        SELECT count(*) AS n_docs, cast(sum(n) AS bigint) AS n_terms FROM n
    ), w AS (
        SELECT term, cast(floor(1000 * ln(cast(2 * n_docs + 2 AS double) / cast(2 * count(*) + 1 AS double))) AS bigint) AS w
        FROM c, k GROUP BY term, n_docs
    ), s AS (
        SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s
        FROM c JOIN w USING (term) JOIN n USING (doc_id), k
    ), t AS (
        SELECT item_id, doc_id, cast(sum(s) AS bigint) AS score FROM i JOIN s USING (term) GROUP BY item_id, doc_id
    ), r AS (
        SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM t WHERE score > 0
    )
    SELECT * FROM r WHERE rank <= 20
    """,
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_filter_audit",
    r"""
    WITH w AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), l AS (
        SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic FROM labels GROUP BY doc_id
    ), m AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
               + 4 * (100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body))::int
               + 8 * regexp_matches(body, '[#$%&*|]')::int
               + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY body), false)::int AS mask
        FROM w LEFT JOIN l ON w.doc_id = l.doc_id
    ), c AS (
        SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
    ), f AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
    ), o AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
             AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), s AS (
        SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::int AS before
        FROM o, (SELECT unnest(range(1, 6)) AS step)
    ), t AS (
        SELECT part, filter_order, step, bit,
               coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit = 0), 0)::bigint AS kept,
               coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::bigint AS removed,
               coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::bigint AS redundant,
               coalesce(sum(n) FILTER (WHERE mask = bit), 0)::bigint AS unique_fails,
               coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::bigint AS good_lost,
               coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::bigint AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM t
    """,
)
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

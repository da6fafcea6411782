"""Queries of entity linkage, enrichment, plans and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import enrichment, learning, linkage, lookups, scratch
from ..streaming import feeds
from . import pipeline
from .registry import Registry

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

BLOCK = ["postal_code"]


def _bigrams(x: str) -> str:
    return f"(CASE WHEN length({x}) < 2 THEN [{x}] ELSE list_distinct([{x}[i:i+1] FOR i IN range(1, length({x}))]) END)"


def _similarity(x: str, y: str) -> str:
    a, b = _bigrams(x), _bigrams(y)
    return (
        f"CASE WHEN {x} = {y} THEN CASE WHEN {x} = '' THEN 0::DOUBLE ELSE 1::DOUBLE END WHEN {x} = '' OR {y} = '' THEN 0::DOUBLE ELSE "
        f"0.5::DOUBLE * (len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)) + 0.5::DOUBLE * (1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}), 1)) END"
    )


PAIRS = ", n AS (SELECT id, postal_code, lower(trim(coalesce(email, ''))) AS e, lower(trim(coalesce(address, ''))) AS ad, lower(trim(coalesce(city, ''))) AS ci, concat_ws(' ', lower(trim(coalesce(address, ''))), lower(trim(coalesce(city, '')))) AS x FROM listings), p AS (SELECT a.id AS id_a, b.id AS id_b, a.e AS ea, b.e AS eb, a.x AS xa, b.x AS xb, a.ad <> '' AND a.ci <> '' AND b.ad <> '' AND b.ci <> '' AS given FROM n a JOIN n b ON a.postal_code = b.postal_code AND a.id < b.id)"
MATCHES = PAIRS + f", s AS (SELECT *, {_similarity('xa', 'xb')} AS sim FROM p), m AS (SELECT id_a, id_b, CASE WHEN ea = eb AND ea <> '' THEN 'email' WHEN given AND sim >= 0.9 THEN 'address' END AS rule, CASE WHEN ea = eb AND ea <> '' THEN 1::DOUBLE ELSE round(sim * 0.9, 3) END AS confidence FROM s)"


@reg.add(", b AS (SELECT postal_code, min(id) AS first_id, count(*) - 1 AS partners FROM listings GROUP BY 1) SELECT id, postal_code, first_id, partners FROM listings JOIN b USING (postal_code)", "listings")
def candidate_pairs(t) -> DataFrame:
    return linkage.blocks_of(t.listings, BLOCK)


#: Classes of equal e-mails and equal addresses in a postal code, and the pairs of similar ones.
CLASSES = PAIRS.split(", p AS (")[0] + f""", c AS (SELECT 'email' AS rule, postal_code, e AS t, min(id) AS k, count(*) AS n FROM n WHERE e <> '' AND postal_code IS NOT NULL GROUP BY ALL UNION ALL SELECT 'address', postal_code, x, min(id), count(*) FROM n WHERE ad <> '' AND ci <> '' AND postal_code IS NOT NULL GROUP BY ALL),
s AS (SELECT least(a.k, b.k) AS class_a, greatest(a.k, b.k) AS class_b, {_similarity('a.t', 'b.t')} AS sim, CASE WHEN a.k < b.k THEN a.n ELSE b.n END AS n_a, CASE WHEN a.k < b.k THEN b.n ELSE a.n END AS n_b FROM c a JOIN c b ON a.rule = 'address' AND b.rule = 'address' AND a.postal_code = b.postal_code AND a.t < b.t),
q AS (SELECT rule, k AS class_a, k AS class_b, CASE rule WHEN 'email' THEN 1::DOUBLE ELSE 0.9::DOUBLE END AS confidence, n AS n_a, n AS n_b FROM c UNION ALL SELECT 'address', class_a, class_b, round(sim * 0.9, 3), n_a, n_b FROM s WHERE sim >= 0.9)"""


MEMBERS = "FROM n JOIN c ON n.postal_code = c.postal_code AND (rule = 'email' AND e = t OR rule = 'address' AND ad <> '' AND ci <> '' AND x = t)"


@reg.add(
    CLASSES + " SELECT rule, class_a, class_b, confidence, n_a AS records_a, n_b AS records_b, NULL::BIGINT AS id FROM q WHERE class_a <> class_b OR n_a > 1 UNION ALL"
    f" SELECT rule, k, k, NULL, NULL, NULL, id {MEMBERS}",
    "listings",
)
def match_rules(t) -> DataFrame:
    """All matches: pairs of classes, and every row of each class, so that a block of equal rows is as many rows here."""
    found = linkage.match_classes(t.listings, None, BLOCK)
    return linkage.in_factors(linkage.Classes(found.members, found.pairs.drop("others_a", "others_b")))


@reg.add(CLASSES + f" SELECT n.id, rule, k AS class_id {MEMBERS}", "listings")
def match_members(t) -> DataFrame:
    return linkage.match_classes(t.listings, None, BLOCK).members.select("id", "rule", "class_id")


@reg.add(PAIRS + f", s AS (SELECT DISTINCT least(xa, xb) AS x_a, greatest(xa, xb) AS x_b, {_similarity('xa', 'xb')} AS sim FROM p WHERE given AND xa <> xb) SELECT x_a, x_b, round(sim, 6) AS similarity FROM s WHERE sim >= 0.8", "listings")
def fuzzy_similarity(t) -> DataFrame:
    """Distinct addresses of one postal code at a similarity of 0.8 or more."""
    rule = linkage.Rule("address", ("address", "city"), "fuzzy")
    texts = linkage._texts(t.listings, BLOCK, rule).select(*BLOCK, "x").distinct()
    return linkage.similar_texts(texts, BLOCK, 0.8).select("x_a", "x_b", F.round("similarity", 6).alias("similarity")).distinct()


@reg.add(
    MATCHES.replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT id_a AS x, id_b AS y FROM m WHERE rule IS NOT NULL UNION SELECT id_b, id_a FROM m WHERE rule IS NOT NULL), r(x, y) AS (SELECT id, id FROM listings UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y) SELECT x AS id, min(y) AS group_id FROM r GROUP BY x",
    "listings",
)
def link_components(t) -> DataFrame:
    links = linkage.by_fuzzy_text(t.listings, BLOCK, linkage.RULES).unionByName(linkage.by_exact_keys(t.listings, BLOCK, linkage.RULES))
    return linkage.link_components(t.listings.select("id"), links)


# the closure of the matches needs a recursive query
ORACLES["link_components"] = ORACLES["link_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@reg.add(
    CLASSES + " SELECT rule, class_a, class_b, confidence, n_a AS records_a, n_b AS records_b, n_a AS others_a, n_b AS others_b, NULL::BIGINT AS id, NULL::INT AS side FROM q UNION ALL"
    f" SELECT rule, k, k, NULL, NULL, NULL, NULL, NULL, id, side {MEMBERS} CROSS JOIN (VALUES (0), (1)) AS s(side)",
    "listings",
)
def link_candidates(t) -> DataFrame:
    """Every listing against all listings as candidates: pairs of classes, and every row of each class on both sides."""
    return linkage.in_factors(linkage.match_classes(t.listings, t.listings, BLOCK), sides=True)


BUDGET = 200
SQL_QUERY = r"regexp_replace(regexp_replace(trim(lower({})), '\s+', ' ', 'g'), '[.,;:!?]+$', '')"
_FIELDS = ("address", "city", "postal_code", "state_province", "name", "email", "phone")


def _filled(template: str) -> str:
    out = template
    for f in _FIELDS:
        out = f"replace({out}, '{{{f}}}', CASE WHEN coalesce(trim({f}), '') <> '' THEN {f} ELSE '{{{f}}}' END)"
    return out


#: What each record asks, in order, with what it finds; then within its own limit and the budget. Needs DIRTY and cleaning's EVIDENCE.
ASKS = (
    f""", x AS (SELECT gaps, l.*, unnest(gaps) AS gap, unnest(range(len(gaps))) AS gap_pos FROM dirty l WHERE municipality_confidence >= 0.6 AND municipality_confidence < 0.7 AND route = 'needs_review'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, gap_type ORDER BY success_count / (success_count + failure_count) DESC, success_count DESC, query_template) AS rank FROM query_templates),
own AS (SELECT gap_type, rank, query_template FROM ranked r WHERE rank <= 2 AND domain = coalesce((SELECT min(domain) FROM ranked q WHERE q.domain = 'real_estate' AND q.gap_type = r.gap_type), '_common')),
f AS (SELECT x.*, rank, query_template, {_filled('query_template')} AS query FROM x JOIN own ON gap_type = gap),
w AS (SELECT {SQL_QUERY.format('query')} AS key, min(text) AS text FROM web_results GROUP BY 1),
e AS (SELECT f.*, w.text, <EVIDENCE> AS value FROM f LEFT JOIN w ON key = {SQL_QUERY.format('query')} WHERE query NOT LIKE '%{{%'),
s AS (SELECT *, min(CASE WHEN coalesce(value, '') <> '' THEN rank END) OVER (PARTITION BY id, gap) AS won FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap_pos, rank) AS seq FROM s WHERE won IS NULL OR rank <= won),
g AS (SELECT *, row_number() OVER (ORDER BY seq, id) AS spent FROM a WHERE seq <= 3),
asked AS (SELECT *, coalesce(value, '') <> '' AS success, regexp_extract(text, 'https?://\\S+') AS url FROM g WHERE spent <= {BUDGET})"""
)


def sql_asks() -> str:
    from .cleaning import SQL_EVIDENCE

    return ASKS.replace("<EVIDENCE>", SQL_EVIDENCE)


def _enriched(t) -> enrichment.Enriched:
    return enrichment.enrich(t.dirty.withColumn("data_confidence", F.least(F.lit(0.9), "municipality_confidence")), t.query_templates, t.web_results, "real_estate", BUDGET)


@reg.add(
    sql_asks() + """ SELECT d.id, coalesce(max(CASE WHEN success AND gap IN ('postal_unresolved', 'municipality_ambiguous') AND last THEN value END), any_value(d.municipality)) AS municipality, coalesce(max(CASE WHEN success AND gap = 'unknown_country' THEN value END), any_value(d.country)) AS country,
 max(CASE WHEN success AND gap = 'unknown_email_domain' THEN value END) AS email_org, max(CASE WHEN success AND gap = 'unknown_phone_format' THEN value END) AS phone_country_code, count(*) FILTER (success) AS evidence
FROM dirty d LEFT JOIN (SELECT *, gap_pos = max(CASE WHEN success AND gap IN ('postal_unresolved', 'municipality_ambiguous') THEN gap_pos END) OVER (PARTITION BY id) AS last FROM asked) k ON d.id = k.id GROUP BY d.id""",
    "listings", "fsa_map", "dirty", "query_templates", "web_results",
)
def enrich_from_evidence(t) -> DataFrame:
    """Every record, with what its gaps were answered by, within three queries a record and a budget for all."""
    return _enriched(t).records.select("id", *enrichment.FIELDS, F.size("evidence").cast("long").alias("evidence"))


@reg.add(
    sql_asks() + """, lost AS (SELECT id, gap, min(rank) AS rank FROM asked GROUP BY id, gap HAVING NOT bool_or(success) AND count(*) = (SELECT count(*) FROM a WHERE a.id = asked.id AND a.gap = asked.gap))
SELECT 'real_estate' AS domain, gap AS gap_type, query_template, success, url_host, count(*) AS n FROM (SELECT gap, query_template, success, nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS url_host FROM asked WHERE success
 UNION ALL SELECT gap, query_template, success, NULL FROM asked JOIN lost USING (id, gap, rank)) GROUP BY ALL""",
    "listings", "fsa_map", "dirty", "query_templates", "web_results",
)
def enrichment_outcomes(t) -> DataFrame:
    return _enriched(t).outcomes.groupBy("domain", "gap_type", "query_template", "success", "url_host").agg(F.count("*").alias("n"))


@reg.add(", s AS (SELECT id, coalesce(trim(city), '') <> '' AS c FROM listings) SELECT id, CASE WHEN c THEN 'standardize_address,fsa_lookup' ELSE '' END AS plan FROM s", "listings")
def plan_lookup(t) -> DataFrame:
    signed = pipeline.record_signature(t.listings, ["city"], "year", "real_estate")
    both = signed.join(t.listings.select("id", "city"), "id").groupBy("signature").agg(F.max(F.coalesce(F.trim("city"), F.lit("")) != "").alias("c"))
    plans = both.select("signature", F.array(F.lit("fsa_lookup"), F.lit("unheard_of"), F.lit("standardize_address")).alias("steps"), F.expr("CASE WHEN c THEN timestamp'2025-01-02' ELSE timestamp'2024-12-31' END").alias("expires_at"))
    known = ["spell_override", "standardize_address", "fsa_lookup"]
    out = learning.plan_lookup(signed, plans, F.lit("2025-01-01").cast("timestamp"), known)
    return out.select("id", F.coalesce("plan", F.lit("")).alias("plan"))


def _place(t) -> str:
    return f"{scratch.shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _events(t) -> DataFrame:
    return feeds.read_feed(t.spark, f"{t.sf_dir}/events.parquet")


@reg.add("SELECT event_id, 'https://' || lower(event_type) || '.org' AS query FROM events")
def stream_clean(t) -> DataFrame:
    out = _events(t).select("event_id", text.normalize_search_query(F.concat(F.lit(" https://"), F.upper("event_type"), F.lit(".org ."))).alias("query"))
    return feeds.run_available(out, _place(t)).select("event_id", F.trim("query").alias("query"))


@reg.add(", m AS (SELECT fsa, min(normalized_municipality) AS n FROM fsa_map GROUP BY 1), e AS (SELECT event_id, ['M0A', 'V8L', 'X9X'][CAST(event_id % 3 AS INT) + 1] AS f FROM events) SELECT event_id, n AS fsa_municipality FROM e LEFT JOIN m ON fsa = f", "listings", "fsa_map")
def stream_lookup(t) -> DataFrame:
    feed = _events(t).select("event_id", F.expr("array('M0A 1H0', 'V8L', 'x9x')[event_id % 3]").alias("postal_code"))
    return feeds.run_available(lookups.fsa_lookup(feed, t.fsa_map).select("event_id", "fsa_municipality"), _place(t))


@reg.add("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, 'gap_' || event_type AS route, count(*) AS records FROM events GROUP BY 1, 2")
def stream_route_counts(t) -> DataFrame:
    """Counts by window as each batch changes them, the last ones: open windows too."""
    out = feeds.run_available(feeds.route_counts(feeds.outcomes_of(_events(t))), _place(t), "update")
    return out.groupBy("start", "route").agg(F.max_by("records", "batch").alias("records"))


@reg.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_insert_ignore(t) -> DataFrame:
    """New keys of a feed in a stored table."""
    return feeds.run_insert_ignore(_events(t).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "event_id", _place(t)).select("user_id", "event_type")


@reg.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_key(t) -> DataFrame:
    out = feeds.first_of_key(_events(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"])
    return feeds.run_available(out, _place(t)).select("user_id", "event_type")


@reg.add(
    """, o AS (SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'real_estate' WHEN 1 THEN 'sports_ticketing' ELSE '_common' END AS domain, concat('host', CAST(user_id % 5 AS VARCHAR), '.org') AS url_host, CASE WHEN value > 10.0 THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END AS step FROM events)
SELECT domain, url_host, round(list_reduce(list(step ORDER BY ts, event_id), lambda s, x: least(1::DOUBLE, greatest(0::DOUBLE, s + x)), 0.5::DOUBLE), 6) AS trust_score FROM o GROUP BY 1, 2"""
)
def stream_outcomes(t) -> DataFrame:
    """Scores of the minutes that ended on the stream, and after them those that are still open."""
    order = ["ts", "event_id"]
    scores, _ = feeds.run_trust(feeds.outcomes_of(_events(t)), order, _place(t))
    return feeds.with_open_minutes(scores, feeds.outcomes_of(t.events), order)

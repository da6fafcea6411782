"""Dirty tables derived from the supplied ones, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SQL over the supplied tables and the fixtures before it.
FIXTURES = {
    "listings": r"""
WITH k AS (
  SELECT c_custkey AS id, c_custkey % 8 AS g, c_custkey - c_custkey % 8 AS b, c_custkey % 11 AS k11, c_name, c_mktsegment
  FROM customer),
p AS (
  SELECT k.*, concat(substr('MVTHKRS', CAST(b % 7 AS INT) + 1, 1), CAST(b % 9 AS STRING),
         substr('ABCEGHJKLNPRSTVWXYZ', CAST(b % 19 AS INT) + 1, 1)) AS fsa,
         CASE b % 7 WHEN 0 THEN 'Toronto' WHEN 1 THEN 'Vancouver' WHEN 2 THEN 'Calgary' WHEN 3 THEN 'Montreal'
                    WHEN 4 THEN 'Ottawa' WHEN 5 THEN 'Winnipeg' ELSE 'Saskatoon' END AS base_city,
         CASE b % 7 WHEN 0 THEN 'ON' WHEN 1 THEN 'BC' WHEN 2 THEN 'AB' WHEN 3 THEN 'QC' WHEN 4 THEN 'ON' WHEN 5 THEN 'MB' ELSE 'SK' END AS base_prov,
         CASE b % 9 WHEN 0 THEN 'Muir' WHEN 1 THEN 'King' WHEN 2 THEN 'St Paul' WHEN 3 THEN 'George' WHEN 4 THEN 'Oak'
                    WHEN 5 THEN 'Elm' WHEN 6 THEN 'Queen' WHEN 7 THEN 'Pine' ELSE 'Birch' END AS base_street
  FROM k)
SELECT id,
  CASE WHEN g = 1 THEN lower(c_name) ELSE c_name END AS name,
  CAST(id % 130 - 3 AS INT) AS age,
  CASE WHEN k11 = 0 THEN NULL ELSE concat(CAST(b % 400 + 1 AS STRING), ' ', base_street, ' ',
    CASE g WHEN 0 THEN 'St' WHEN 1 THEN 'street' WHEN 2 THEN 'St.' WHEN 3 THEN 'Blvd NE' WHEN 4 THEN 'Street'
           WHEN 5 THEN 'st' WHEN 6 THEN '  Pkwy ' ELSE 'St, Apt 4' END) END AS address,
  CASE WHEN k11 = 1 THEN '' WHEN g = 5 AND b % 7 = 0 THEN 'Toronot' WHEN g = 2 THEN lower(base_city) ELSE base_city END AS city,
  CASE g WHEN 1 THEN lower(concat(fsa, '1', 'h', '7')) WHEN 2 THEN fsa WHEN 3 THEN NULL WHEN 6 THEN '1001'
         ELSE concat(fsa, ' 1H', CAST(b % 5 AS STRING)) END AS postal_code,
  CASE WHEN g = 3 THEN NULL WHEN g = 6 THEN 'N/A' ELSE base_city END AS municipality,
  CASE WHEN g = 4 THEN 'ON' WHEN g = 6 THEN 'XX' ELSE base_prov END AS state_province,
  CASE g WHEN 0 THEN 'CA' WHEN 1 THEN 'canada' WHEN 2 THEN 'Canads' WHEN 3 THEN NULL WHEN 4 THEN 'CA'
         WHEN 5 THEN 'Canada' WHEN 6 THEN 'Atlantis' ELSE 'USA' END AS country,
  CASE id % 5 WHEN 0 THEN '4165550123' WHEN 1 THEN '1-416-555-0123' WHEN 2 THEN '+31 20 5555555' WHEN 3 THEN '555-1234' ELSE NULL END AS phone,
  CASE WHEN k11 < 4 THEN concat('u', CAST(id - id % 3 AS STRING), '@example.com') WHEN k11 = 4 THEN NULL
       ELSE concat('u', CAST(id AS STRING), '@mail.example.com') END AS email,
  CASE k11 WHEN 5 THEN 0.95 WHEN 6 THEN 0.80 WHEN 7 THEN 0.65 WHEN 8 THEN 0.40 ELSE CAST(NULL AS DOUBLE) END AS municipality_confidence,
  CAST(2015 + id % 12 AS INT) AS year
FROM p
""",
    "ticket_events": r"""
SELECT event_id,
  concat(CASE event_id % 6 WHEN 0 THEN 'Leafs' WHEN 1 THEN 'habs' WHEN 2 THEN ' Sens' WHEN 3 THEN 'Oilers' WHEN 4 THEN 'Toronto Raptors' ELSE 'Yankees' END,
    CASE event_id % 5 WHEN 0 THEN ' vs ' WHEN 1 THEN ' vs. ' WHEN 2 THEN ' @ ' WHEN 3 THEN ' AT ' ELSE ' - ' END,
    CASE event_id % 7 WHEN 0 THEN 'Jets' WHEN 1 THEN 'Flames' WHEN 2 THEN 'canucks ' WHEN 3 THEN 'Blue Jays' WHEN 4 THEN 'Red Sox' WHEN 5 THEN 'senators' ELSE 'Raptors' END) AS event_name,
  CAST(ts AS DATE) AS event_date,
  CASE event_id % 3 WHEN 0 THEN 'Scotiabank Arena' WHEN 1 THEN 'Scotiabnk Arena' ELSE 'Bell Centre' END AS venue_name,
  CASE event_id % 6 WHEN 0 THEN 'Leafs' WHEN 1 THEN 'Habs' WHEN 2 THEN 'Sens' WHEN 3 THEN 'Oilers' WHEN 4 THEN 'Raptors' ELSE 'Yankees' END AS home_team
FROM events
""",
    "ticket_products": r"""
SELECT p_partkey AS product_id,
  CASE p_partkey % 8 WHEN 0 THEN 'Full Season Package' WHEN 1 THEN 'Half-Season - 19 Games' WHEN 2 THEN 'Flex Voucher 10-pack'
    WHEN 3 THEN 'Single Game Ticket' WHEN 4 THEN '82-game full season' WHEN 5 THEN p_name WHEN 6 THEN '' ELSE NULL END AS product_name,
  CASE WHEN p_partkey % 8 = 7 THEN 'Gift credit' ELSE NULL END AS ticket_type,
  CASE WHEN p_partkey % 16 = 3 THEN 'vip' ELSE NULL END AS ticket_category FROM part
""",
    "fsa_map": r"""
SELECT DISTINCT substr(upper(postal_code),1,3) AS fsa, state_province AS province, 'CA' AS country, base AS normalized_municipality,
  CAST('2016-01-01' AS DATE) AS valid_from, CASE WHEN base = 'Ottawa' THEN CAST('2021-12-31' AS DATE) ELSE CAST(NULL AS DATE) END AS valid_to
FROM (SELECT postal_code, state_province, municipality AS base, id FROM listings WHERE id % 8 = 0 AND id % 3 <> 0)
""",
    "spell_overrides": r"""
SELECT * FROM (VALUES ('scarbbrough','scarborough'),('scarbrough','scarborough'),('toronot','toronto'),('north yokr','north york'),('etobicoe','etobicoke'),('yorl','york'),('oakvile','oakville'),('vaughn','vaughan'),('postal cod','postal code'),('provice','province'),('municpality','municipality')) AS t(wrong, fixed)
""",
    "query_outcomes": r"""
SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'real_estate' WHEN 1 THEN 'sports_ticketing' ELSE '_common' END AS domain,
  concat('gap_', event_type) AS gap_type, concat('{postal_code} q', CAST(user_id % 4 AS STRING)) AS query_template,
  concat('host', CAST(user_id % 5 AS STRING), '.org') AS url_host, value > 10.0 AS success FROM events
""",
    "flags": r"""
SELECT o_orderkey AS id, o_custkey AS raw_data_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'unknown_country' WHEN 1 THEN 'postal_unresolved' WHEN 2 THEN 'municipality_unresolved' ELSE 'low_confidence_research' END AS flag_type,
  CASE o_orderstatus WHEN 'F' THEN 'INFO' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'WARN' END AS severity,
  o_orderdate AS raised_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY ELSE CAST(NULL AS TIMESTAMP) END AS resolved_at FROM orders
""",
    "search_results": r"""
SELECT doc_id AS record_id, CASE doc_id % 5 WHEN 0 THEN 'postal_unresolved' WHEN 1 THEN 'municipality_ambiguous' WHEN 2 THEN 'unknown_country' WHEN 3 THEN 'unknown_email_domain' ELSE 'unknown_phone_format' END AS gap,
  concat(CASE doc_id % 4 WHEN 0 THEN 'Deliveries to North York and Toronto. ' WHEN 1 THEN 'The City of Markham is in York Region, Canada. ' WHEN 2 THEN 'Acme Widgets is a company. Dial +44 country code. ' ELSE '' END,
  text, ' URL: https://example.org/', CAST(doc_id AS STRING)) AS text FROM documents
""",
    "dirty": r"""
SELECT l.*, CASE WHEN m.fsa IS NULL AND trim(coalesce(postal_code, '')) <> '' THEN true ELSE false END AS unknown_fsa,
  CASE WHEN (CASE WHEN coalesce(name, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(city, '') <> '' THEN 1 ELSE 0 END)
    + (CASE WHEN coalesce(postal_code, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(country, '') <> '' THEN 1 ELSE 0 END) >= 4 AND coalesce(municipality_confidence, 0.9) >= 0.6 THEN 'needs_review' ELSE 'done' END AS route,
  split(concat_ws(',', CASE WHEN m.fsa IS NULL AND trim(coalesce(postal_code, '')) <> '' THEN 'postal_unresolved' END, CASE WHEN municipality_confidence < 0.7 THEN 'municipality_ambiguous' END,
    CASE WHEN coalesce(country, '') IN ('CA', 'canada', 'Canada', 'USA') THEN NULL ELSE 'unknown_country' END, CASE WHEN email LIKE '%@mail.%' THEN 'unknown_email_domain' END,
    CASE WHEN phone = '555-1234' THEN 'unknown_phone_format' END), ',') AS gaps
FROM listings l LEFT JOIN (SELECT DISTINCT fsa FROM fsa_map) m ON m.fsa = substr(upper(replace(postal_code, ' ', '')), 1, 3)
""",
    "query_templates": r"""
SELECT * FROM (VALUES ('real_estate', 'postal_unresolved', '{postal_code} canada postal code municipality', 30, 10), ('real_estate', 'postal_unresolved', 'site:wikipedia.org {postal_code} FSA', 3, 7), ('real_estate', 'postal_unresolved', 'never asked {postal_code}', 1, 9),
  ('real_estate', 'municipality_ambiguous', '{postal_code} municipality {state_province}', 8, 2), ('real_estate', 'municipality_ambiguous', '{city} {state_province} municipality boundary', 5, 5),
  ('real_estate', 'unknown_country', '{address} {city} country code', 6, 4), ('real_estate', 'unknown_country', '{city} {state_province} country', 5, 5), ('_common', 'unknown_country', 'not {city}', 9, 1),
  ('_common', 'unknown_email_domain', '{email} organization', 4, 6), ('_common', 'unknown_email_domain', '{name} company', 2, 8), ('_common', 'unknown_phone_format', '{phone} {city} dial code', 5, 5)) AS t(domain, gap_type, query_template, success_count, failure_count)
""",
    "web_results": r"""
SELECT query, CASE WHEN length(query) % 3 = 0 THEN 'nothing of use here' WHEN kind = 1 THEN concat('Deliveries to ', city, ', ', CASE WHEN length(query) % 2 = 0 THEN 'Etobicoke' ELSE 'Markham' END, ' and beyond URL: https://post.example.org/', CAST(length(query) AS STRING))
    WHEN kind = 2 THEN concat('The city of ', CASE WHEN length(query) % 2 = 0 THEN 'Oak Park' ELSE 'King' END, ' is here. URL: https://maps.example.org/x') WHEN kind = 3 THEN concat('A place in ', CASE WHEN length(query) % 2 = 0 THEN 'Canada' ELSE 'the United States' END, ', URL: http://geo.example.net')
    WHEN kind = 4 THEN 'Acme Mail is an organization. URL: https://who.example.com/a?b' ELSE 'Dial +44 country code' END AS text
FROM (SELECT 1 AS kind, city, concat(postal_code, '  canada postal code Municipality.') AS query FROM listings UNION ALL SELECT 1, city, concat('site:wikipedia.org ', lower(postal_code), ' fsa') FROM listings
  UNION ALL SELECT 2, city, concat(postal_code, ' municipality ', state_province) FROM listings UNION ALL SELECT 2, city, concat(city, ' ', state_province, ' municipality boundary') FROM listings
  UNION ALL SELECT 3, city, concat(address, ' ', city, ' country code') FROM listings UNION ALL SELECT 3, city, concat(city, ' ', state_province, ' country') FROM listings
  UNION ALL SELECT 4, city, concat(email, ' organization') FROM listings UNION ALL SELECT 4, city, concat(name, ' company') FROM listings UNION ALL SELECT 5, city, concat(phone, ' ', city, ' dial code') FROM listings) AS q
WHERE query IS NOT NULL AND length(query) % 5 <> 0
""",
    "judge_scores": r"""
SELECT event_id AS test_case_id, user_id % 4 AS run_id, round(CAST(event_id % 101 AS DOUBLE) / 100, 2) AS correctness, round(CAST(event_id % 11 AS DOUBLE) / 10, 2) AS format,
  round(CAST(event_id % 7 AS DOUBLE) / 6, 3) AS instruction_following FROM events
""",
}
NEEDS = {"fsa_map": ("listings",), "dirty": ("listings", "fsa_map"), "web_results": ("listings",)}


def with_names(names: tuple[str, ...]) -> list[str]:
    """The fixtures of ``names`` and what they need, in order."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*with_names(NEEDS.get(n, ())), n) if x not in out]
    return out


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` over fixtures as common table expressions (``body`` may begin with more of them and a comma)."""
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in with_names(names))
    if not ctes:
        return "WITH " + body[2:] if body.startswith(", ") else body
    return f"WITH {ctes}{body}" if body.startswith(", ") else f"WITH {ctes} {body}"


class Tables:
    """The supplied tables and the fixtures of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        sql = FIXTURES[name]
        for t in (*BASE, *NEEDS.get(name, ())):
            if f"FROM {t}" in sql or f"JOIN {t}" in sql:
                getattr(self, t).createOrReplaceTempView(t)
        return self.spark.sql(sql)

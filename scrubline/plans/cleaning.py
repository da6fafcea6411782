"""Queries of text cleaning, validation, gaps, triage and the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks, places, text
from ..functions.missing import is_blank
from ..operators import fields, isolation, learning, lookups, tables
from . import pipeline
from .registry import Registry

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def sql_title(x: str) -> str:
    return rf"array_to_string([upper(r[1]) || r[2:] FOR r IN regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+')], '')"


def sql_case(x: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def sql_list(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


COUNTRY = sql_case("coalesce(lower(trim(country)), '')", places.COUNTRY_ALIASES)


def sql_spell(column: str) -> str:
    return f"""CASE WHEN o.fixed IS NULL THEN {column} WHEN upper({column}[1]) = {column}[1] AND lower({column}[1]) <> {column}[1] THEN {sql_title('o.fixed')} ELSE o.fixed END"""


@reg.add(f"SELECT id, {sql_spell('city')} AS city FROM listings LEFT JOIN spell_overrides o ON lower(city) = o.wrong", "listings", "spell_overrides")
def spell_override(t) -> DataFrame:
    return learning.spell_override(t.listings, "city", t.spell_overrides).select("id", "city")


@reg.add("SELECT * FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term, count(*) AS n FROM documents GROUP BY 1) WHERE n >= 5")
def build_dictionary(t) -> DataFrame:
    return learning.build_dictionary(t.documents)


@reg.add(
    """, terms AS (SELECT lower(city) AS term, count(*) AS n FROM listings WHERE city IS NOT NULL AND city <> '' GROUP BY 1 HAVING count(*) * 20 >= (SELECT count(*) FROM listings)),
v AS (SELECT DISTINCT lower(city) AS value FROM listings WHERE length(city) > 1 AND lower(city) NOT IN (SELECT term FROM terms))
SELECT value, term AS suggestion, 1 AS distance FROM (SELECT value, term, row_number() OVER (PARTITION BY value ORDER BY n DESC, term) AS r FROM v JOIN terms ON damerau_levenshtein(value, term) = 1) WHERE r = 1""",
    "listings",
)
def spell_dictionary(t) -> DataFrame:
    """Terms are cities that a twentieth of all listings have."""
    least = t.listings.count() / 20
    terms = t.listings.where("city <> ''").groupBy(F.lower("city").alias("term")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return learning.spell_dictionary(t.listings, "city", terms)


@reg.add(
    """WITH terms AS (SELECT * FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term, count(*) AS n FROM documents GROUP BY 1) WHERE n >= 5),
v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS value FROM benchmark), w AS (SELECT value FROM v WHERE length(value) > 1 AND value NOT IN (SELECT term FROM terms))
SELECT value, term AS suggestion, 1 AS distance FROM (SELECT value, term, row_number() OVER (PARTITION BY value ORDER BY n DESC, term) AS r FROM w JOIN terms ON damerau_levenshtein(value, term) = 1) WHERE r = 1"""
)
def spell_from_documents(t) -> DataFrame:
    """Words of the benchmark that documents don't have, by the dictionary of the documents."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word"))
    return learning.spell_dictionary(words, "word", learning.build_dictionary(t.documents))


def _sql_standard() -> str:
    out = "address"
    for k, v in {**text.QUADRANTS, **text.STREET_TYPES}.items():
        out = rf"regexp_replace({out}, '\b{k}\b', '{v}', 'gi')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@reg.add(f"SELECT id, {_sql_standard()} AS address FROM listings", "listings")
def standardize_address(t) -> DataFrame:
    return t.listings.select("id", text.standardize_address("address").alias("address"))


@reg.add(f"SELECT id, {COUNTRY} AS country_code FROM listings", "listings")
def normalize_country(t) -> DataFrame:
    return learning.normalize_country(t.listings, "country").select("id", "country_code")


@reg.add()
def suggest_country(t) -> DataFrame:
    return learning.normalize_country(t.listings, "country").groupBy("country", "country_code", "country_suggestion").agg(F.count("*").alias("n"))


def _sql_cache_key() -> str:
    out = rf"regexp_replace(regexp_replace(trim(split_part(regexp_replace(trim(address), '^\d+\s+', ''), ',', 1)), '[.,]', '', 'g'), '\s+', ' ', 'g')"
    out = sql_title(out)
    for k, v in text.TRAILING_TYPES.items():
        out = rf"regexp_replace({out}, '\b{k}\.?$', '{v}', 'i')"
    return f"coalesce(trim({out}), '')"


@reg.add(f"SELECT id, {_sql_cache_key()} AS address_key FROM listings", "listings")
def address_cache_key(t) -> DataFrame:
    return t.listings.select("id", text.address_cache_key("address").alias("address_key"))


@reg.add(f"SELECT p_partkey AS id, {sql_title('p_name')} AS title FROM part")
def title_case(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), text.title_case("p_name").alias("title"))


@reg.add(r"SELECT record_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[.,;:!?]+$', '') AS query FROM search_results", "search_results")
def normalize_search_query(t) -> DataFrame:
    return t.search_results.select("record_id", text.normalize_search_query("text").alias("query"))


def _sql_team(x: str) -> str:
    return sql_case(f"lower(trim({x}))", text.TEAM_ALIASES, f"trim({x})")


@reg.add(
    rf""", s AS (SELECT event_id, event_name, regexp_extract(trim(event_name), '^(.+?)\s+(?:vs\.?|@|at)\s+(.+)$', 1, 'i') AS l, regexp_extract(trim(event_name), '^(.+?)\s+(?:vs\.?|@|at)\s+(.+)$', 2, 'i') AS r FROM ticket_events),
n AS (SELECT *, {_sql_team('l')} || ' vs ' || {_sql_team('r')} AS new FROM s)
SELECT event_id, CASE WHEN l <> '' AND lower(new) <> lower(event_name) THEN new ELSE event_name END AS event_name FROM n""",
    "ticket_events",
)
def normalize_event_name(t) -> DataFrame:
    return t.ticket_events.select("event_id", text.normalize_event_name("event_name").alias("event_name"))


@reg.add(
    rf""", a AS (SELECT lower(trim(home_team)) AS alias, 'the ' || min(home_team) AS name FROM ticket_events GROUP BY 1), s AS (SELECT event_id, event_name, regexp_extract(trim(event_name), '^(.+?)\s+(?:vs\.?|@|at)\s+(.+)$', 1, 'i') AS l, regexp_extract(trim(event_name), '^(.+?)\s+(?:vs\.?|@|at)\s+(.+)$', 2, 'i') AS r FROM ticket_events),
n AS (SELECT s.*, coalesce(x.name, {_sql_team('l')}) || ' vs ' || coalesce(y.name, {_sql_team('r')}) AS new FROM s LEFT JOIN a x ON x.alias = lower(trim(l)) LEFT JOIN a y ON y.alias = lower(trim(r)))
SELECT event_id, CASE WHEN l <> '' AND lower(new) <> lower(event_name) THEN new ELSE event_name END AS event_name FROM n""",
    "ticket_events",
)
def normalize_event_aliases(t) -> DataFrame:
    """Names by a table of aliases, the home teams, before the built-in ones."""
    aliases = t.ticket_events.select(F.col("home_team").alias("alias"), F.concat(F.lit("the "), "home_team").alias("canonical"))
    return learning.normalize_events(t.ticket_events.select("event_id", "event_name"), "event_name", aliases.distinct())


@reg.add(
    ", s AS (SELECT *, coalesce(nullif(product_name, ''), nullif(ticket_type, '')) AS x FROM ticket_products), c AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(x, '{p}', 'i') THEN '{k}'" for k, p in text.PRODUCT_PATTERNS.items())
    + """ END AS found FROM s)
SELECT product_id, CASE WHEN x IS NULL OR coalesce(ticket_category, '') <> '' THEN ticket_category ELSE coalesce(found, 'individual') END AS ticket_category,
  CASE WHEN x IS NULL OR coalesce(ticket_category, '') <> '' THEN NULL WHEN found IS NULL THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM c""",
    "ticket_products",
)
def categorize_product(t) -> DataFrame:
    category, sure = text.product_category("product_name", "ticket_type", "ticket_category")
    return t.ticket_products.select("product_id", category.alias("ticket_category"), sure.alias("confidence"))


GAPS = {"country": None, "postal_code": "country", "municipality": "country"}


def _sql_gaps() -> str:
    def gap(c: str, by: str | None) -> str:
        q = f"CASE WHEN coalesce(trim({by}), '') <> '' THEN '|' || lower(trim({by})) ELSE '' END" if by else "''"
        return f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'missing:{c}' || {q} END"

    return "[g FOR g IN [" + ", ".join(gap(c, by) for c, by in GAPS.items()) + "] IF g IS NOT NULL]"


@reg.add(f"SELECT id, array_to_string({_sql_gaps()}, ',') AS gaps FROM listings", "listings")
def classify_gaps(t) -> DataFrame:
    return t.listings.select("id", F.array_join(checks.classify_gaps(GAPS), ",").alias("gaps"))


@reg.add(
    f", m AS (SELECT DISTINCT fsa FROM fsa_map), g AS (SELECT l.*, {_sql_gaps()} AS gs, coalesce(trim(postal_code), '') <> '' AND m.fsa IS NULL AS u FROM listings l LEFT JOIN m ON m.fsa = upper(replace(postal_code, ' ', ''))[1:3])"
    " SELECT id, array_to_string(gs || [x FOR x IN [CASE WHEN u THEN 'postal_unresolved' END, CASE WHEN municipality_confidence < 0.70 THEN 'municipality_ambiguous' END] IF x IS NOT NULL], ',') AS gaps FROM g",
    "listings",
    "fsa_map",
)
def identify_gaps(t) -> DataFrame:
    df = lookups.fsa_lookup(t.listings, t.fsa_map)
    return df.select("id", F.array_join(checks.identify_gaps(checks.classify_gaps(GAPS), F.col("unknown_fsa"), F.col("municipality_confidence")), ",").alias("gaps"))


@reg.add(
    f", g AS (SELECT id, [split_part(split_part(x, '|', 1), '+', 1) FOR x IN {_sql_gaps()}] AS gs FROM listings) SELECT id, array_to_string([f FOR f IN [" + sql_case("x", checks.GAP_FLAGS) + " FOR x IN gs] IF f IS NOT NULL], ',') AS flags FROM g",
    "listings",
)
def flags_from_gaps(t) -> DataFrame:
    return t.listings.select("id", F.array_join(checks.flags_from_gaps(checks.classify_gaps(GAPS)), ",").alias("flags"))


@reg.add(
    f", g AS (SELECT id, unnest({_sql_gaps()}) AS gap FROM listings) SELECT id, gap, split_part(split_part(gap, '|', 1), ':', 1) AS verb, split_part(split_part(gap, '|', 1), ':', 2) AS fields, nullif(split_part(gap, '|', 2), '') AS qualifier, true AS valid FROM g",
    "listings",
)
def parse_gap(t) -> DataFrame:
    df = t.listings.select("id", F.explode(checks.classify_gaps(GAPS)).alias("gap"))
    p = checks.parse_gap("gap")
    return df.select("id", "gap", p["verb"].alias("verb"), F.array_join(p["fields"], "+").alias("fields"), p["qualifier"].alias("qualifier"), checks.is_valid_gap("gap").alias("valid"))


SQL_ESCALATE = f"""[x FOR x IN [CASE WHEN upper(trim(coalesce(country, ''))) NOT IN {sql_list(places.ACCEPTED_COUNTRIES)} THEN 'unknown_country' END,
 CASE WHEN upper(trim(coalesce(postal_code, ''))) IN ('', 'N/A') THEN 'postal_unresolved' WHEN trim(postal_code) LIKE '%?' THEN 'postal_ambiguous' END,
 CASE WHEN upper(trim(coalesce(municipality, ''))) IN ('', 'N/A') THEN 'municipality_unresolved' END] IF x IS NOT NULL]"""


@reg.add(f"SELECT id, array_to_string({SQL_ESCALATE}, ',') AS flags FROM listings", "listings")
def needs_escalation(t) -> DataFrame:
    return t.listings.select("id", F.array_join(checks.needs_escalation(), ",").alias("flags"))


@reg.add(
    f""", h AS (SELECT *, {SQL_ESCALATE} AS hints FROM listings), r AS (SELECT id, hints, CASE WHEN id % 2 = 0 THEN 'CA' ELSE country END AS country, postal_code, coalesce(nullif(nullif(municipality, 'N/A'), ''), CASE WHEN id % 3 = 0 THEN city END) AS municipality FROM h),
a AS (SELECT id, hints, {SQL_ESCALATE} AS after FROM r)
SELECT id, array_to_string([x FOR x IN hints IF list_contains(after, x)], ',') AS surviving, len([x FOR x IN hints IF list_contains(after, x)]) < len(hints) AS cleared FROM a""",
    "listings",
)
def escalation_outcome(t) -> DataFrame:
    before = t.listings.withColumn("hints", checks.needs_escalation())
    fixes = t.listings.select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'CA' END").alias("country"), F.expr("CASE WHEN coalesce(municipality, 'N/A') IN ('N/A', '') AND id % 3 = 0 THEN city END").alias("municipality"))
    after = pipeline.apply_resolutions(before, fixes, ["country", "municipality"]).withColumn("after", checks.needs_escalation())
    o = checks.escalation_outcome(F.col("hints"), F.col("after"))
    return after.select("id", F.array_join(o["surviving"], ",").alias("surviving"), o["cleared"].alias("cleared"))


@reg.add(
    "SELECT id, CASE WHEN id % 3 = 0 AND coalesce(city, '') <> '' THEN city ELSE municipality END AS municipality, CASE WHEN id % 3 = 0 AND coalesce(city, '') <> '' AND municipality IS DISTINCT FROM city THEN 'municipality' ELSE '' END AS changed, CASE WHEN id % 3 = 0 AND coalesce(city, '') <> '' THEN 0.85::DOUBLE ELSE 0.40::DOUBLE END AS confidence FROM listings",
    "listings",
)
def apply_resolutions(t) -> DataFrame:
    fixes = t.listings.where("id % 3 = 0").select("id", F.col("city").alias("municipality"))
    out = pipeline.apply_resolutions(t.listings, fixes, ["municipality"])
    return out.select("id", "municipality", F.array_join("resolved_fields", ",").alias("changed"), "resolution_confidence").withColumnRenamed("resolution_confidence", "confidence")


@reg.add(
    rf""", s AS (SELECT *, upper(coalesce(country, 'CA')) AS c, upper(coalesce(state_province, '')) AS p, replace(upper(postal_code), ' ', '') AS z FROM listings), k AS (SELECT id,
 CASE WHEN coalesce(postal_code, '') = '' THEN NULL """
    + " ".join(f"WHEN c = '{k}' THEN regexp_matches(z, '{v}')" for k, v in places.POSTAL_PATTERNS.items())
    + f""" ELSE true END AS postal_ok,
 CASE WHEN p = '' THEN NULL WHEN c = 'CA' THEN p IN {sql_list(places.CA_PROVINCES)} WHEN c = 'USA' THEN p IN {sql_list([x for x in places.US_STATES if x != "DC"])} END AS province_ok,
 CASE WHEN c = 'CA' AND p = 'ON' AND coalesce(municipality, '') <> '' THEN CASE WHEN municipality IN {sql_list(places.ONTARIO_KNOWN)} THEN 0.95::DOUBLE ELSE 0.70::DOUBLE END END AS hierarchy_confidence FROM s)
SELECT *, postal_ok IS NOT NULL OR province_ok IS NOT NULL OR hierarchy_confidence IS NOT NULL AS geographic_validated FROM k""",
    "listings",
)
def geographic_validate(t) -> DataFrame:
    c = checks.geographic_checks()
    return t.listings.select("id", *[v.alias(k) for k, v in c.items()])


@reg.add(
    f""", s AS (SELECT *, {COUNTRY} AS code FROM listings)
SELECT id, array_to_string([x FOR x IN [CASE WHEN age NOT BETWEEN 1 AND 120 THEN 'age' END, CASE WHEN coalesce(country, '') <> '' AND code IS NULL THEN 'country' END,
 CASE WHEN code = 'US' AND coalesce(state_province, '') <> '' THEN CASE WHEN upper(state_province) IN {sql_list(places.US_STATES)} THEN 'state_abbreviation' WHEN state_province NOT IN {sql_list(places.US_STATES.values())} THEN 'state_unknown' END END,
 CASE WHEN code = 'NL' AND coalesce(phone, '') NOT IN ('', 'N/A') AND phone NOT LIKE '+31%' THEN 'nl_phone' END] IF x IS NOT NULL], ',') AS violations FROM s""",
    "listings",
)
def guardrails(t) -> DataFrame:
    return t.listings.select("id", F.array_join(checks.violations(), ",").alias("violations"))


SQL_LETTER = sql_case("upper(trim(postal_code)[1])", places.POSTAL_LETTERS)


@reg.add(f"SELECT id, CASE WHEN coalesce({COUNTRY}, 'CA') = 'CA' THEN NOT ({SQL_LETTER} = upper(trim(state_province)) OR ({SQL_LETTER} = 'NT' AND upper(trim(state_province)) = 'NU')) END AS mismatch FROM listings", "listings")
def cross_province_check(t) -> DataFrame:
    return t.listings.select("id", places.cross_province("postal_code", "state_province", "country").alias("mismatch"))


SQL_CLASS = r"""CASE WHEN coalesce(trim(postal_code), '') = '' THEN 'missing' WHEN regexp_matches(upper(replace(postal_code, ' ', '')), '^[A-Z]\d[A-Z]\d[A-Z]\d$') THEN 'full'
 WHEN regexp_matches(upper(replace(postal_code, ' ', '')), '^[A-Z]\d[A-Z]$') THEN 'partial' ELSE 'malformed' END"""


@reg.add(f"SELECT id, {SQL_CLASS} AS postal_class FROM listings", "listings")
def postal_class(t) -> DataFrame:
    return t.listings.select("id", places.postal_class("postal_code").alias("postal_class"))


@reg.add("SELECT id, upper(trim(coalesce(municipality, ''))) IN ('', 'N/A') OR length(trim(coalesce(postal_code, ''))) < 5 AS needs_research FROM listings", "listings")
def needs_research(t) -> DataFrame:
    return t.listings.select("id", pipeline.needs_research().alias("needs_research"))


@reg.add(
    rf""", s AS (SELECT *, {COUNTRY} AS code, upper(replace(postal_code, ' ', '')) AS z FROM listings) SELECT id, CASE WHEN code = 'CA' AND regexp_matches(z, '^[A-Z]\d[A-Z]\d[A-Z]\d$') THEN z[1:3] || ' ' || z[4:6]
 WHEN code = 'NL' AND regexp_matches(z, '^\d{{4}}[A-Z]{{2}}$') THEN z[1:4] || ' ' || z[5:6] ELSE postal_code END AS postal_code FROM s""",
    "listings",
)
def normalize_postal(t) -> DataFrame:
    return t.listings.select("id", places.normalize_postal("postal_code", "country").alias("postal_code"))


@reg.add(
    rf""", s AS (SELECT id, coalesce({COUNTRY}, 'CA') AS code, regexp_replace(phone, '\D', '', 'g') AS d FROM listings), l AS (SELECT *, CASE WHEN length(d) = 10 THEN d WHEN length(d) = 11 AND d[1] = '1' THEN d[2:11] END AS n,
 CASE code WHEN 'NL' THEN '31' WHEN 'MX' THEN '52' WHEN 'JP' THEN '81' END AS cc FROM s),
b AS (SELECT *, CASE WHEN starts_with(d, cc) THEN d[length(cc) + 1:] ELSE regexp_replace(d, '^0', '') END AS r FROM l)
SELECT id, coalesce(CASE WHEN code IN ('CA', 'US') THEN '(' || n[1:3] || ') ' || n[4:6] || '-' || n[7:10] WHEN cc IS NOT NULL AND length(r) >= 8 THEN '+' || cc || ' ' || r END, 'N/A') AS phone FROM b""",
    "listings",
)
def format_phone(t) -> DataFrame:
    return t.listings.select("id", places.format_phone("phone", "country").alias("phone"))


@reg.add(
    f"SELECT id, coalesce(CASE WHEN {COUNTRY} = 'US' THEN {sql_case('upper(trim(state_province))', places.US_STATES)} END, CASE WHEN coalesce({COUNTRY}, 'CA') = 'CA' THEN {sql_case('upper(trim(state_province))', places.CA_PROVINCE_NAMES)} END, state_province) AS region FROM listings",
    "listings",
)
def expand_region(t) -> DataFrame:
    return t.listings.select("id", places.expand_region("state_province", "country").alias("region"))


@reg.add(f"SELECT id, trim({sql_title('name')}) AS name, trim({sql_title('city')}) AS city FROM listings", "listings")
def clean_name_city(t) -> DataFrame:
    return t.listings.select("id", *[F.trim(text.title_case(c)).alias(c) for c in ("name", "city")])


@reg.add("SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages")
def url_host(t) -> DataFrame:
    return t.pages.select("page_id", text.url_host("url").alias("host"))


@reg.add("SELECT id, sha256(coalesce(address, '') || '|' || coalesce(city, '') || '|' || coalesce(postal_code, '') || '|' || coalesce(country, '') || '|ca')[1:32] AS geocode_key FROM listings", "listings")
def geocode_key(t) -> DataFrame:
    return t.listings.select("id", text.geocode_key("address", "city", "postal_code", "country", F.lit("ca")).alias("geocode_key"))


@reg.add("SELECT id, coalesce(address, '') || ' | ' || coalesce(city, '') || ' | ' || coalesce(postal_code, '') AS embedding_text FROM listings", "listings")
def embedding_text(t) -> DataFrame:
    return t.listings.select("id", text.embedding_text("address", "city", "postal_code").alias("embedding_text"))


@reg.add(
    "SELECT id, query FROM (SELECT id, CASE WHEN coalesce(trim(postal_code), '') <> '' AND coalesce(trim(city), '') <> '' THEN 'municipality of ' || postal_code || ' ' || city END AS query FROM listings) WHERE query IS NOT NULL",
    "listings",
)
def fill_query_template(t) -> DataFrame:
    q = text.fill_template(F.lit("municipality of {postal_code} {city}"), {"postal_code": "postal_code", "city": "city"})
    return t.listings.select("id", q.alias("query")).where("query IS NOT NULL")


@reg.add("SELECT event_id, props AS json FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def extract_json(t) -> DataFrame:
    told = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```\ndone"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("The answer is "), "props")).otherwise("no object here")
    return t.events.select("event_id", text.extract_json(told).alias("json"))


@reg.add(
    """, s AS (SELECT CASE WHEN coalesce(trim(country), '') = '' THEN '' ELSE 'country' END || CASE WHEN coalesce(trim(city), '') = '' THEN '' ELSE ',city' END AS present, round(municipality_confidence, 1) AS c, route, list_sort(gaps) AS gaps FROM dirty)
SELECT n AS shape_size, count(*) AS shapes FROM (SELECT present, c, route, gaps, count(*) AS n FROM s GROUP BY ALL) GROUP BY n""",
    "listings", "fsa_map", "dirty",
)
def record_signature(t) -> DataFrame:
    signed = pipeline.record_signature(t.dirty, ["country", "city"], "municipality_confidence", "real_estate")
    return signed.groupBy("signature").agg(F.count("*").alias("shape_size")).groupBy("shape_size").agg(F.count("*").alias("shapes"))


SQL_COMPLETE = "((CASE WHEN coalesce(name, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(city, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(postal_code, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(country, '') <> '' THEN 1 ELSE 0 END)) / 5.0::DOUBLE"


@reg.add(f"SELECT id, {SQL_COMPLETE} AS completeness, least(0.9::DOUBLE, municipality_confidence) AS confidence FROM listings", "listings")
def completeness(t) -> DataFrame:
    return t.listings.select("id", checks.completeness(pipeline.REAL_ESTATE.required).alias("completeness"), checks.data_confidence([F.col("municipality_confidence")], []).alias("confidence"))


@reg.add(
    f""", s AS (SELECT id, {SQL_COMPLETE} AS p, least(0.9::DOUBLE, municipality_confidence) AS c FROM listings)
SELECT id, CASE WHEN p < 0.7 THEN 'unsalvageable' WHEN c >= 0.85 AND p >= 0.8 THEN 'done' WHEN c >= 0.6 THEN 'needs_review' ELSE 'unsalvageable' END AS route,
 CASE WHEN p < 0.7 THEN 1::DOUBLE WHEN c >= 0.85 AND p >= 0.8 THEN least(p, c) WHEN c >= 0.6 THEN c ELSE 1::DOUBLE END AS confidence FROM s""",
    "listings",
)
def triage(t) -> DataFrame:
    r = checks.triage(checks.completeness(pipeline.REAL_ESTATE.required), checks.data_confidence([F.col("municipality_confidence")], []))
    return t.listings.select("id", r["route"].alias("route"), r["confidence"].alias("confidence"))


@reg.add(
    """, s AS (SELECT id, round(CASE WHEN id % 7 = 0 THEN greatest(x - 0.25, 0) ELSE x END, 2) AS score FROM (SELECT id, (CASE WHEN id % 2 = 0 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN id % 3 = 0 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN id % 5 < 3 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN id % 11 < 6 THEN 0.1::DOUBLE ELSE 0 END) AS x FROM listings))
SELECT id, score, CASE WHEN score >= 0.85 THEN 'auto_complete' WHEN score >= 0.6 THEN 'agent_review' ELSE 'human_review' END AS route FROM s""",
    "listings",
)
def additive_score(t) -> DataFrame:
    s = checks.additive_score(*[F.expr(e) for e in ("id % 2 = 0", "id % 3 = 0", "id % 5 < 3", "id % 11 < 6", "id % 7 = 0")])
    return t.listings.select("id", s["score"].alias("score"), s["route"].alias("route"))


@reg.add(
    f""", p AS (SELECT id, city AS wrong, {sql_spell('city')} AS fixed FROM listings LEFT JOIN spell_overrides o ON lower(city) = o.wrong)
SELECT lower(trim(wrong)) AS wrong, lower(trim(fixed)) AS fixed, count(*) AS n FROM p WHERE trim(wrong) <> '' AND trim(fixed) <> '' AND lower(trim(wrong)) <> lower(trim(fixed)) AND length(trim(wrong)) >= 4 AND NOT regexp_matches(wrong, '[0-9]') AND levenshtein(lower(trim(wrong)), lower(trim(fixed))) <= 2 GROUP BY 1, 2""",
    "listings",
    "spell_overrides",
)
def propose_corrections(t) -> DataFrame:
    return learning.propose_corrections(t.listings, learning.spell_override(t.listings, "city", t.spell_overrides), ["city", "municipality"])


@reg.add(
    f""", p AS (SELECT lower(city) AS wrong, lower({sql_spell('city')}) AS fixed FROM listings LEFT JOIN spell_overrides o ON lower(city) = o.wrong), q AS (SELECT DISTINCT wrong, fixed FROM p WHERE wrong <> fixed AND wrong <> '')
SELECT wrong, fixed, 'manual_seed' AS source, 1::DOUBLE AS confidence FROM spell_overrides WHERE wrong <> 'toronot' UNION ALL SELECT wrong, fixed, 'learned', 0.75::DOUBLE FROM q""",
    "listings",
    "spell_overrides",
)
def record_learned(t) -> DataFrame:
    seeds = t.spell_overrides.where("wrong <> 'toronot'").select("wrong", "fixed", F.lit("manual_seed").alias("source"), F.lit(1.0).alias("confidence"))
    found = learning.propose_corrections(t.listings, learning.spell_override(t.listings, "city", t.spell_overrides), ["city"])
    return learning.record_learned(seeds, found)


SQL_MUNI = "|".join(learning.MUNICIPALITIES)
SQL_PLACE = sql_title(r"trim(regexp_extract(text, '(?:municipality|city|town|village)\s+(?:of\s+)?([A-Z][a-zA-Z\s]+?)(?:\.|,|\s+is|\s+has)', 1, 'i'))")


#: The value that a text gives for a gap.
SQL_EVIDENCE = rf"""CASE gap WHEN 'postal_unresolved' THEN {sql_title(rf"regexp_extract(text, '\b({SQL_MUNI})\b', 1, 'i')")}
 WHEN 'municipality_ambiguous' THEN CASE WHEN length({SQL_PLACE}) BETWEEN 3 AND 50 THEN {SQL_PLACE} END
 WHEN 'unknown_country' THEN CASE WHEN regexp_matches(text, '\bCanada\b', 'i') THEN 'CA' WHEN regexp_matches(text, '\bUnited States\b|\bUSA\b|\bU\.S\.A\b', 'i') THEN 'US' WHEN regexp_matches(text, '\bUnited Kingdom\b|\bUK\b|\bGB\b', 'i') THEN 'GB' END
 WHEN 'unknown_email_domain' THEN trim(regexp_extract(text, '([A-Z][a-zA-Z\s]+?)\s+is\s+(?:a|an)\s+(?:company|organization|corporation)', 1, 'i'))
 ELSE CASE WHEN regexp_matches(text, '\+(\d{{1,3}})\s+(?:country|code|dial)', 'i') THEN '+' || regexp_extract(text, '\+(\d{{1,3}})\s+(?:country|code|dial)', 1, 'i') END END"""


@reg.add(
    rf""", v AS (SELECT record_id, gap, text, {SQL_EVIDENCE} AS value FROM search_results)
SELECT record_id, gap, value, regexp_extract(text, 'https?://\S+') AS source_url FROM v WHERE coalesce(value, '') <> ''""",
    "search_results",
)
def parse_evidence(t) -> DataFrame:
    return learning.read_evidence(t.search_results).select("record_id", "gap", "e.value", "e.source_url")


LISTING = ("id", "name", "age", "address", "city", "postal_code", "municipality", "state_province", "country", "phone", "email", "municipality_confidence", "year")


@reg.add(
    """, r(column_name, p, inferred_role, role_confidence) AS (VALUES """
    + ", ".join(f"('{k}', {i}, '{r}', {c}::DOUBLE)" for i, (k, (r, c)) in enumerate(pipeline.ROLES.items()))
    + """), c AS (SELECT unnest(["""
    + ", ".join(f"'{c}'" for c in LISTING)
    + """]) AS column_name, unnest(["""
    + ", ".join(f"count({c})" for c in LISTING)
    + """]) AS filled FROM listings)
SELECT c.column_name, any_value(c.filled) AS filled, coalesce(arg_min(r.inferred_role, p), 'generic_text') AS inferred_role, coalesce(arg_min(r.role_confidence, p), 0.30::DOUBLE) AS role_confidence FROM c LEFT JOIN r ON c.column_name LIKE replace(r.column_name, '_', '\\_') ESCAPE '\\' GROUP BY 1""".replace("\\\\", "\\"),
    "listings",
)
def infer_column_role(t) -> DataFrame:
    """Roles of the columns of listings, with how many of their values are there."""
    counts = t.listings.agg(*[F.count(c).alias(c) for c in LISTING])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in LISTING])).alias("x")).select("x.*")
    return pipeline.infer_roles(long).select("column_name", "filled", "inferred_role", "role_confidence")


@reg.add(
    f""", o AS (SELECT l.*, {sql_spell('city')} AS city2 FROM listings l LEFT JOIN spell_overrides o ON lower(city) = o.wrong), k AS (SELECT *, {SQL_COMPLETE} AS p, least(0.9::DOUBLE, municipality_confidence, CASE WHEN coalesce(postal_code, '') <> '' OR coalesce(state_province, '') <> '' THEN 0.85 END) AS c FROM o),
r AS (SELECT CASE WHEN p < 0.7 THEN 'unsalvageable' WHEN c >= 0.85 AND p >= 0.8 THEN 'done' WHEN c >= 0.6 THEN 'needs_review' ELSE 'unsalvageable' END AS route FROM k) SELECT route, count(*) AS records FROM r GROUP BY 1""",
    "listings",
    "spell_overrides",
    name="clean_pipeline_first_routes",
)
def _first_routes(t) -> DataFrame:
    first = pipeline.deterministic(t.listings, t.spell_overrides)
    return pipeline.triaged(first, pipeline.REAL_ESTATE).groupBy("route").agg(F.count("*").alias("records"))


def _given(t) -> pipeline.Given:
    """All tables; plans by signature and resolutions are made from the listings themselves."""
    geocodes = t.listings.select(text.geocode_key("address", "city", "postal_code", "country", F.lit("ca")).alias("query_hash"), F.lit("43.6").alias("lat"), F.lit("-79.4").alias("lon"), F.col("city").alias("display_name"), F.expr("timestamp'2024-12-20 00:00:00'").alias("fetched_at"))
    resolutions = t.listings.where("id % 2 = 0").select("id", F.col("municipality"), F.lit("CA").alias("country"), F.when(F.col("postal_code").isNull(), "M4N 2A7").alias("postal_code"), F.lit("").alias("city"), F.lit(None).cast("string").alias("address"))
    return pipeline.Given(t.spell_overrides, t.fsa_map, t.query_templates, t.web_results, geocodes, None, resolutions, budget=100)


ROUTES = f""", o AS (SELECT l.*, m.fsa IS NOT NULL AS known, trim(coalesce(postal_code, '')) <> '' AS given FROM listings l LEFT JOIN (SELECT DISTINCT fsa FROM fsa_map) m ON m.fsa = substr(upper(regexp_replace(postal_code, '\\s', '', 'g')), 1, 3)),
k AS (SELECT *, <COMPLETE> AS p, CASE WHEN coalesce(postal_code, '') <> '' OR coalesce(state_province, '') <> '' THEN 0.85::DOUBLE END AS v FROM o),
one AS (SELECT *, least(0.9::DOUBLE, municipality_confidence, v) AS c FROM k),
r1 AS (SELECT *, CASE WHEN p < 0.7 THEN 'unsalvageable' WHEN c >= 0.85 AND p >= 0.8 THEN 'done' WHEN c >= 0.6 THEN 'needs_review' ELSE 'unsalvageable' END AS first FROM one),
two AS (SELECT *, least(0.9::DOUBLE, CASE WHEN given THEN CASE WHEN known THEN 0.95 ELSE 0.0 END ELSE municipality_confidence END, v) AS c2 FROM r1),
routes AS (SELECT id, CASE WHEN first <> 'needs_review' THEN first WHEN c2 >= 0.85 AND p >= 0.8 THEN 'done' WHEN c2 >= 0.6 THEN 'needs_review' ELSE 'unsalvageable' END AS route FROM two)"""


@reg.add(ROUTES.replace("<COMPLETE>", SQL_COMPLETE) + " SELECT id, route FROM routes", "listings", "fsa_map")
def clean_pipeline_routes(t) -> DataFrame:
    """The final route of every record after all phases: lookups decide, queries and resolutions fill fields."""
    return pipeline.routed(t.listings, pipeline.REAL_ESTATE, _given(t)).select("id", "route")


@reg.add(
    ROUTES.replace("<COMPLETE>", SQL_COMPLETE) + """, n AS (SELECT route, count(*) AS n FROM routes GROUP BY route)
SELECT 'Cleaned ' || sum(n) || '/' || sum(n) || ' records. Routes: ' || string_agg(route || ' ' || n, ', ' ORDER BY route) || '. ' || CAST(sum(n) FILTER (route <> 'done') AS VARCHAR) || ' flagged. 0 errors.' AS summary FROM n""",
    "listings",
    "fsa_map",
)
def run_summary(t) -> DataFrame:
    return lookups.run_summary(pipeline.routed(t.listings, pipeline.REAL_ESTATE, _given(t)))


@reg.add()
def clean_pipeline(t) -> DataFrame:
    out = pipeline.clean(t.listings, pipeline.REAL_ESTATE, _given(t))
    return out.select("id", "address", "city", "postal_code", "municipality", "country", "route", "group_id", F.array_join("flags", ",").alias("flags"), F.col("audit_entries"))


@reg.add()
def clean_tickets(t) -> DataFrame:
    """The second domain's configuration over ticket events and the products of the same number."""
    rows = t.ticket_events.join(t.ticket_products, F.col("event_id") == F.col("product_id"), "left").withColumnRenamed("event_id", "id")
    out = pipeline.clean(rows, pipeline.SPORTS_TICKETING, pipeline.Given())
    return out.select("id", "event_name", "ticket_category", "group_id", "audit_entries")


@reg.add()
def run_report(t) -> DataFrame:
    """Counts by route; groups aren't in it, so nothing is linked."""
    out = pipeline.routed(t.listings, pipeline.REAL_ESTATE, _given(t))
    return lookups.run_report(out.withColumn("audit_entries", F.size("audit").cast("long")))


@reg.add("SELECT id, age, CASE WHEN age IS NULL THEN 'age is not a number' END AS error FROM (SELECT id, TRY_CAST(CASE WHEN id % 10 = 0 THEN age::VARCHAR || 'x' ELSE age::VARCHAR END AS INT) AS age FROM listings)", "listings")
def error_isolation(t) -> DataFrame:
    raw = t.listings.select("id", F.expr("CASE WHEN id % 10 = 0 THEN concat(CAST(age AS STRING), 'x') ELSE CAST(age AS STRING) END").alias("age"))
    return pipeline.typed(raw, {"age": "int"}).select("id", "age", "error")


def _months(batch) -> dict[str, list]:
    """For a step's test: the age as a number of months; it fails on texts that are no number."""
    return {"months": [None if v is None else 12 * int(v) for v in batch.column(batch.schema.names.index("age")).to_pylist()]}


@reg.add("SELECT id, CASE WHEN id % 10 = 0 THEN age || 'x' ELSE age::VARCHAR END AS age, CASE WHEN id % 10 <> 0 THEN 12 * age END AS months, id % 10 = 0 AND age IS NOT NULL AS failed, CASE WHEN id % 10 = 0 AND age IS NOT NULL THEN 1 ELSE 0 END AS audit_entries FROM listings", "listings")
def step_isolation(t) -> DataFrame:
    """A step in Python that raises on some rows: these have an error and an audit entry, the others their values."""
    raw = t.listings.select("id", F.expr("CASE WHEN id % 10 = 0 THEN concat(CAST(age AS STRING), 'x') ELSE CAST(age AS STRING) END").alias("age"))
    out = isolation.isolated(raw, "months", _months, "months long")
    return out.select("id", "age", "months", F.col("error").isNotNull().alias("failed"), F.size("audit").alias("audit_entries"))


@reg.add()
def domain_config(t) -> DataFrame:
    """The domains' steps in running order, with how many values each changed in listings."""
    first = pipeline.deterministic(t.listings, t.spell_overrides)
    changed = first.select(F.explode("audit").alias("a")).groupBy(F.lit("real_estate").alias("domain"), F.col("a.skill").alias("step")).agg(F.count("*").alias("changed"))
    return pipeline.steps_table(t.spark).join(changed, ["domain", "step"], "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


@reg.add(
    """, s AS (SELECT *, CASE WHEN coalesce(trim(municipality), '') = '' THEN city ELSE municipality END AS new FROM listings)
SELECT id, municipality AS old_municipality, new AS new_municipality FROM s WHERE municipality IS DISTINCT FROM new""",
    "listings",
)
def municipality_changes(t) -> DataFrame:
    after = t.listings.withColumn("municipality", F.when(is_blank("municipality"), F.col("city")).otherwise(F.col("municipality")))
    return learning.municipality_changes(t.listings, after)


@reg.add(
    "SELECT id, '| ' || id || ' | ' || coalesce(address, '') || ' | ' || coalesce(city, '') || ' | ' || coalesce(postal_code, '') || ' | ' || coalesce(municipality, '') || ' | ' || coalesce(state_province, '') || ' | ' || coalesce(country, '') || ' | ' ||"
    " concat_ws('; ', CASE WHEN coalesce(trim(municipality), '') = '' THEN 'municipality missing' END, CASE WHEN length(coalesce(trim(postal_code), '')) < 5 THEN 'postal missing/incomplete' END) || ' |' AS line FROM listings",
    "listings",
)
def research_table_format(t) -> DataFrame:
    return tables.format_rows(t.listings)


_RULES = {
    "country": fields.FieldRule(places.COUNTRY_ALIASES),
    "postal_code": fields.FieldRule(valid=(r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$", r"^\d{5}(-\d{4})?$"), reject=(r"^.{1,3}$",)),
    "city": fields.FieldRule(reject=(r"^[a-zA-Z]$",)),
}


@reg.add(
    f""", v AS (SELECT id, 'country' AS field, country AS raw FROM listings UNION ALL SELECT id, 'postal_code', postal_code FROM listings UNION ALL SELECT id, 'city', city FROM listings),
s AS (SELECT v.*, {sql_case('lower(trim(raw))', places.COUNTRY_ALIASES)} AS mapped, o.fixed FROM v LEFT JOIN spell_overrides o ON field = 'city' AND o.wrong = lower(trim(raw)) WHERE coalesce(trim(raw), '') <> '')
SELECT id, field, CASE WHEN field = 'country' AND mapped IS NOT NULL THEN mapped WHEN field = 'city' AND NOT regexp_matches(raw, '^[a-zA-Z]$') AND fixed IS NOT NULL THEN fixed ELSE raw END AS value,
  CASE WHEN field = 'country' AND mapped = raw THEN 'valid' WHEN field = 'country' AND mapped IS NOT NULL THEN 'mapped'
       WHEN field = 'postal_code' AND regexp_matches(raw, '^[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d$|^\\d{{5}}(-\\d{{4}})?$') THEN 'valid'
       WHEN field = 'city' AND NOT regexp_matches(raw, '^[a-zA-Z]$') AND fixed IS NOT NULL THEN 'learned' ELSE 'open' END AS outcome FROM s
UNION ALL SELECT id, 'email', NULL, 'skipped: sensitive field' FROM listings WHERE coalesce(trim(email), '') <> ''""",
    "listings",
    "spell_overrides",
)
def clean_fields(t) -> DataFrame:
    """Countries by their map, postal codes by their patterns, cities by learned corrections; emails are sensitive."""
    types = fields.field_types(["id", "country", "postal_code", "city", "email"], sensitive={"email"})
    learned = t.spell_overrides.select(F.lit("city").alias("field_type"), F.col("wrong").alias("raw"), F.col("fixed").alias("corrected"), F.lit(0.95).alias("confidence"), F.lit(True).alias("enabled"))
    return fields.clean_fields(t.listings, types, _RULES, learned).select("id", "field", "value", "outcome")

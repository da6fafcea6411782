"""Queries of table upkeep, lookups, reports, rankings, vectors and places."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import buckets, lookups, retrieval, scratch, spatial, tables, vectors
from ..sources import load
from . import cleaning, pipeline
from .registry import Registry

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.add("SELECT id, name, city FROM listings WHERE city = 'Toronto' AND country = 'CA' ORDER BY id LIMIT 50", "listings")
def query_rows(t) -> DataFrame:
    return tables.query_rows(t.listings, {"city": "Toronto", "country": "CA"}).select("id", "name", "city")


@reg.add("SELECT r_regionkey, r_name FROM region")
def read_table(t) -> DataFrame:
    return load.read_table(t.spark, "parquet", f"{t.sf_dir}/region.parquet")


@reg.add(
    ", seen AS (SELECT DISTINCT lower(city) AS wrong FROM listings WHERE city <> '') SELECT wrong, wrong AS fixed, 'seen' AS source, 0.5::DOUBLE AS confidence, 'real_estate' AS domain FROM seen UNION ALL SELECT wrong, fixed, CASE WHEN length(wrong) > 8 THEN 'mine' ELSE 'manual_seed' END, 1::DOUBLE, 'real_estate' FROM spell_overrides WHERE wrong NOT IN (SELECT wrong FROM seen)",
    "listings", "spell_overrides",
)
def load_corrections_csv(t) -> DataFrame:
    """A file of corrections read into a table that has the cities' own spellings."""
    place = f"{scratch.shared_dir(t.spark)}/corrections-{uuid.uuid4().hex}"
    raw = t.spell_overrides.select(F.concat(F.lit(" "), F.upper("wrong"), F.lit(" ")).alias("wrong"), F.upper("fixed").alias("right"), F.when(F.length("wrong") > 8, "mine").alias("source"), F.lit(None).cast("double").alias("confidence"))
    raw.write.option("header", "true").csv(place)
    seen = t.listings.where("city <> ''").select(F.lower("city").alias("wrong")).distinct()
    target = seen.select("wrong", F.col("wrong").alias("fixed"), F.lit("seen").alias("source"), F.lit(0.5).alias("confidence"), F.lit("real_estate").alias("domain"))
    return load.load_corrections(t.spark, place, "real_estate", target)


@reg.add(
    ", k AS (SELECT DISTINCT domain, url_host FROM query_outcomes WHERE success) SELECT domain, url_host, 0.5::DOUBLE AS trust_score FROM k UNION SELECT domain, url_host, 0.8::DOUBLE FROM query_outcomes o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.domain = o.domain AND k.url_host = o.url_host)",
    "query_outcomes",
)
def load_trusted_sources(t) -> DataFrame:
    """Packs trust all hosts; those that answered before are in the registry already."""
    known = t.query_outcomes.where("success").select("domain", "url_host", F.lit(0.5).alias("trust_score")).distinct()
    packs = t.query_outcomes.groupBy("domain").agg(F.collect_set("url_host").alias("trusted_sources"))
    return load.trusted_sources(packs, known)


@reg.add(
    ", p AS (SELECT DISTINCT domain, gap_type, query_template FROM query_outcomes) SELECT domain, gap_type, query_template FROM p",
    "query_outcomes",
)
def load_query_packs(t) -> DataFrame:
    packs = t.query_outcomes.groupBy("domain", "gap_type").agg(F.array_sort(F.collect_set("query_template")).alias("seeds"))
    packs = packs.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("gap_type", "seeds"))).alias("gap_types"))
    return load.query_packs(packs)


@reg.add(
    ", m AS (SELECT flag_type AS table_name, severity AS column_name, count(*) AS n FROM flags GROUP BY 1, 2), o AS (SELECT DISTINCT 'd' AS domain, flag_type AS table_name, 'id' AS column_name, 'an id' AS description, NULL::VARCHAR AS gap_detection FROM flags UNION SELECT 'e', flag_type, severity, 'another domain', NULL FROM flags)"
    " SELECT * FROM o UNION ALL SELECT 'd' AS domain, table_name, column_name, 'seen ' || n AS description, '{\"missing\":true}' AS gap_detection FROM m",
    "flags",
)
def load_column_metadata(t) -> DataFrame:
    """Nested metadata upserted into a table with older descriptions, other columns and another domain."""
    rows = t.flags.groupBy(F.col("flag_type").alias("table_name"), F.col("severity").alias("column")).agg(F.count("*").alias("n"))
    nested = rows.groupBy("table_name").agg(F.collect_list(F.struct("column", F.concat(F.lit("seen "), F.col("n")).alias("description"), F.struct(F.lit(True).alias("missing")).alias("gap_detection"))).alias("columns"))
    nested = nested.groupBy(F.lit("d").alias("domain")).agg(F.map_from_entries(F.collect_list(F.struct("table_name", "columns"))).alias("tables"))
    old = lambda domain, column, text: t.flags.select(F.lit(domain).alias("domain"), F.col("flag_type").alias("table_name"), column.alias("column_name"), F.lit(text).alias("description"), F.lit(None).cast("string").alias("gap_detection")).distinct()
    target = old("d", F.lit("id"), "an id").unionByName(old("d", F.col("severity"), "older")).unionByName(old("e", F.col("severity"), "another domain"))
    return load.load_column_metadata(nested, target)


@reg.add(
    """, c AS (SELECT page_id, 'M' || (page_id % 10) || 'A' AS a, 'K' || (page_id % 9) || 'B' AS b FROM pages), x AS (SELECT a AS fsa, 'Town ' || (page_id % 7) AS municipality, 'ON' AS province FROM c UNION ALL SELECT b, 'Village', 'ON' FROM c)
SELECT DISTINCT fsa, municipality, province FROM x"""
)
def extract_fsa_from_html(t) -> DataFrame:
    cell = lambda c, n: F.concat(F.lit("<td><b>"), c, F.lit("</b><br><a href='x'>"), n, F.lit("</a> (East)</td>"))
    a, b = (F.concat(F.lit(p), (F.col("page_id") % n).cast("string"), F.lit(s)) for p, n, s in (("M", 10, "A"), ("K", 9, "B")))
    html = F.concat("html", F.lit("<table><tr>"), cell(a, F.concat(F.lit("Town "), F.col("page_id") % 7)), cell(b, F.lit("Village")), cell(F.lit("M9Z"), F.lit("Not assigned")), F.lit("<td>none</td></tr></table>"))
    return load.fsa_cells(t.pages.select(html.alias("html"))).distinct()


BOXES = "SELECT n_nationkey AS polygon_id, (n_nationkey % 5) * 20.0::DOUBLE AS x0, (n_nationkey // 5) * 20.0::DOUBLE AS y0, (n_nationkey % 5) * 20.0::DOUBLE + 25 AS x1, (n_nationkey // 5) * 20.0::DOUBLE + 15 AS y1, n_nationkey AS ord FROM nation"


@reg.add(f"WITH b AS ({BOXES}), p AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 1300) / 10.0::DOUBLE + 0.05 AS x, (c_custkey * 53 % 1100) / 10.0::DOUBLE + 0.05 AS y FROM customer) SELECT point_id, arg_min(polygon_id, ord) AS polygon_id FROM p JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1")
def point_in_polygon_join(t) -> DataFrame:
    return spatial.point_in_polygon(*_places(t)).select("point_id", "polygon_id")


@reg.add(f"WITH b AS ({BOXES}), p AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 1300) / 10.0::DOUBLE + 0.05 AS x, (c_custkey * 53 % 1100) / 10.0::DOUBLE + 0.05 AS y FROM customer), h AS (SELECT DISTINCT point_id FROM p JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1) SELECT (SELECT count(*) FROM h) AS matched, (SELECT count(*) FROM p) - (SELECT count(*) FROM h) AS unmatched")
def points_outside(t) -> DataFrame:
    """How many points polygons hold, and how many none does."""
    return spatial.located(*_places(t))[1]


def _places(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 20.0, F.floor(k / 5) * 20.0
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(x0, y0), corner(x0 + 25, y0), corner(x0 + 25, y0 + 15), corner(x0, y0 + 15))
    polygons = t.nation.select(k.alias("polygon_id"), k.alias("ord"), ring.alias("ring"))
    c = F.col("c_custkey")
    points = t.customer.select(c.alias("point_id"), ((c * 37 % 1300) / 10.0 + 0.05).alias("x"), ((c * 53 % 1100) / 10.0 + 0.05).alias("y"))
    return points, polygons


@reg.add("WITH tgt AS (SELECT o_custkey AS k, 'order ' || min(o_orderkey) AS v FROM orders GROUP BY 1) SELECT k, v FROM tgt UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM tgt)")
def insert_ignore(t) -> DataFrame:
    """Customers into a table of those with orders."""
    return tables.insert_ignore(_ordered(t), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"], "v")


def _ordered(t) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("order "), F.min("o_orderkey")).alias("v"))


@reg.add(
    "WITH r AS (SELECT 'customer' AS kind, o_custkey AS k, 'order ' || max(o_orderkey) AS v FROM orders GROUP BY 2 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier), tgt AS (SELECT 'customer' AS kind, c_custkey AS k, c_name AS v FROM customer)"
    " SELECT coalesce(tgt.kind, r.kind) AS kind, coalesce(tgt.k, r.k) AS k, coalesce(r.v, tgt.v) AS v, CASE WHEN tgt.k IS NULL THEN 'new' ELSE 'old' END AS w FROM tgt FULL JOIN r ON tgt.kind = r.kind AND tgt.k = r.k"
)
def upsert(t) -> DataFrame:
    """Every order, of which a customer's last one counts, and every supplier into a table of all customers, which has no suppliers."""
    target = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit("old").alias("w"))
    orders = t.orders.select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("k"), F.concat(F.lit("order "), "o_orderkey").alias("v"), F.lit("new").alias("w"), F.col("o_orderkey").alias("n"))
    suppliers = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.lit("new").alias("w"), F.lit(0).cast("long").alias("n"))
    return tables.upsert(target, orders.unionByName(suppliers), ["kind", "k"], ["v"], "n")


@reg.add(
    "WITH tgt AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, c_name FROM customer)"
    " SELECT coalesce(tgt.k, r.k) AS k, coalesce(c_name, 'order ' || v) AS v FROM tgt FULL JOIN r ON tgt.k = r.k"
)
def stored_upsert(t) -> DataFrame:
    """A stored table of customers with orders, in buckets, after an upsert of all customers."""
    table = buckets.Stored(t.spark, f"{scratch.shared_dir(t.spark)}/stored-{uuid.uuid4().hex}", ("k",), 16).create(_ordered(t))
    table.upsert(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(1).alias("n")), ["v"], "n")
    return table.read()


@reg.add("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncleaned_only(t) -> DataFrame:
    return tables.uncleaned_only(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("raw_data_id")))


@reg.add("SELECT id, country FROM listings WHERE country = 'CA' ORDER BY id LIMIT 5", "listings")
def scope_filter(t) -> DataFrame:
    s = tables.scope_filter("clean the first Canadian records")
    return tables.query_rows(t.listings, {"country": s["country"]}, s["limit"]).select("id", "country")


@reg.add(
    "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN nullif(city, '') END, municipality) AS municipality, concat_ws(' | ', CASE WHEN id % 3 = 0 THEN 'Pre-cleaned: city; phone' END, CASE WHEN id % 2 = 0 THEN 'looked up' END) AS validation_notes FROM listings",
    "listings",
)
def merge_results(t) -> DataFrame:
    raw = t.listings.withColumn("pre_changes", F.expr("CASE WHEN id % 3 = 0 THEN array('city', 'phone') ELSE array() END"))
    out = t.listings.where("id % 2 = 0").select("id", F.col("city").alias("municipality"), F.lit("looked up").alias("validation_notes"))
    return tables.merge_results(raw, out, ["municipality"]).select("id", "municipality", "validation_notes")


@reg.add(
    f""", d AS (SELECT l.*, {cleaning.sql_spell('city')} AS city2, {cleaning._sql_standard()} AS address2 FROM listings l LEFT JOIN spell_overrides o ON lower(city) = o.wrong)
SELECT 'cleaned' AS kind, id, NULL AS what FROM d UNION ALL SELECT 'audit', id, 'spell_override' FROM d WHERE city2 IS DISTINCT FROM city UNION ALL SELECT 'audit', id, 'standardize_address' FROM d WHERE address2 IS DISTINCT FROM address
UNION ALL SELECT 'flag', id, 'country' FROM d WHERE coalesce(trim(country), '') = '' UNION ALL SELECT 'flag', id, 'municipality' FROM d WHERE coalesce(trim(municipality), '') = ''""",
    "listings", "spell_overrides",
)
def persist_cleaned(t) -> DataFrame:
    """Cleaned rows, their audit and their flags as written to the three tables of a run."""
    from ..functions.missing import is_blank

    place = f"{scratch.shared_dir(t.spark)}/run-{uuid.uuid4().hex}"
    flags = checks.array_of(*[F.when(is_blank(c), c) for c in ("country", "municipality")])
    tables.persist(pipeline.deterministic(t.listings, t.spell_overrides).withColumn("flags", flags), place, "r1")
    read = lambda name, what: t.spark.read.parquet(f"{place}/{name}").select(F.lit(name.rstrip("s")).alias("kind"), "id", what.cast("string").alias("what"))
    return read("cleaned", F.lit(None)).unionByName(read("audit", F.col("skill"))).unionByName(read("flags", F.col("flags")))


#: Updates of listings by the orders of the customer with the same number.
SQL_UPDATES = """, u AS (SELECT o_custkey AS id, CAST(count(*) * 9 AS INT) AS age, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'Netherlands' WHEN max(o_orderkey) % 3 = 1 THEN 'USA' END AS country,
 CASE min(o_orderkey) % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'California' WHEN 2 THEN 'Nowhere' END AS state_province, CASE min(o_orderkey) % 3 WHEN 0 THEN '+31 20 1' WHEN 1 THEN '020 1' END AS phone FROM orders GROUP BY 1),
e AS (SELECT l.id, u.id AS asked, u.age AS a2, u.country AS c2, u.state_province AS s2, u.phone AS p2, l.age, l.country, l.state_province, l.phone, coalesce(u.country, l.country) AS c FROM listings l LEFT JOIN u ON l.id = u.id),
v AS (SELECT *, [x FOR x IN [CASE WHEN a2 NOT BETWEEN 1 AND 120 THEN 'age' END, CASE WHEN c IN ('USA', 'usa') AND s2 IS NOT NULL THEN CASE s2 WHEN 'CA' THEN 'state_abbreviation' WHEN 'Nowhere' THEN 'state_unknown' END END, CASE WHEN c = 'Netherlands' AND p2 = '020 1' THEN 'nl_phone' END] IF x IS NOT NULL] AS why FROM e)"""
_UPDATED = ["age", "country", "state_province", "phone"]


def _updated(t) -> tuple[DataFrame, DataFrame]:
    low, high = F.min("o_orderkey"), F.max("o_orderkey")
    asked = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        (F.count("*") * 9).cast("int").alias("age"), F.when(high % 3 == 0, "Netherlands").when(high % 3 == 1, "USA").alias("country"),
        F.when(low % 4 == 0, "CA").when(low % 4 == 1, "California").when(low % 4 == 2, "Nowhere").alias("state_province"), F.when(low % 3 == 0, "+31 20 1").when(low % 3 == 1, "020 1").alias("phone"),
    )
    return tables.update_fields(t.listings.select("id", *_UPDATED), asked, _UPDATED, tables.update_reasons(_UPDATED))


@reg.add(SQL_UPDATES + " SELECT id, " + ", ".join(f"CASE WHEN len(why) = 0 THEN coalesce({n}, {c}) ELSE {c} END AS {c}" for n, c in (("a2", "age"), ("c2", "country"), ("s2", "state_province"), ("p2", "phone"))) + " FROM v", "listings")
def update_fields(t) -> DataFrame:
    return _updated(t)[0]


@reg.add(SQL_UPDATES + " SELECT id, array_to_string(why, ',') AS reasons FROM v WHERE asked IS NOT NULL AND len(why) > 0", "listings")
def update_rejects(t) -> DataFrame:
    return _updated(t)[1].select("id", F.array_join("reasons", ",").alias("reasons"))


@reg.add("SELECT c_custkey AS id FROM customer WHERE NOT (c_custkey > 0 AND c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)))")
def delete_guarded(t) -> DataFrame:
    raw = t.customer.select(F.col("c_custkey").alias("id"))
    deletes = raw.select("id", F.expr("CASE WHEN id % 3 <> 0 THEN 'yes' ELSE 'no' END").alias("confirm"), F.expr("id % 5 = 0").alias("override"))
    return tables.delete_guarded(raw, t.orders.select(F.col("o_custkey").alias("raw_data_id")), deletes)


@reg.add("SELECT id, resolved_at IS NULL AND id % 3 = 0 AS by_us, CASE WHEN resolved_at IS NULL AND id % 3 = 0 THEN 'ann' END AS resolved_by FROM flags", "flags")
def resolve_flags(t) -> DataFrame:
    given = t.flags.where("id % 3 = 0").select("id", F.lit("2025-01-01").cast("timestamp").alias("at"), F.lit("ann").alias("by"), F.lit("seen").alias("note"))
    return tables.resolve_flags(t.flags, given).select("id", F.coalesce(F.col("resolution_note") == "seen", F.lit(False)).alias("by_us"), "resolved_by")


@reg.add("SELECT id, flag_type FROM flags WHERE resolved_at IS NULL AND flag_type = 'postal_unresolved' ORDER BY raised_at DESC, id LIMIT 100", "flags")
def query_flags(t) -> DataFrame:
    return tables.query_flags(t.flags, unresolved=True, flag_type="postal_unresolved").select("id", "flag_type")


@reg.add("SELECT id, flag_type, severity FROM flags WHERE raw_data_id = 7", "flags")
def record_history(t) -> DataFrame:
    return tables.record_history(t.flags, 7).select("id", "flag_type", "severity")


@reg.add(
    "WITH c AS (SELECT s_suppkey AS k, 5::BIGINT AS h FROM supplier), w AS (SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS v, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT coalesce(c.k, w.k)::VARCHAR AS lookup_key, CASE WHEN w.k IS NOT NULL THEN v::VARCHAR ELSE 'old' END AS lookup_value, CASE WHEN c.h IS NULL THEN n - 1 ELSE c.h + coalesce(n, 0) END AS hit_count FROM c FULL JOIN w ON c.k = w.k"
)
def cache_upsert(t) -> DataFrame:
    return tables.cache_upsert(*_cache(t)).select("lookup_key", "lookup_value", "hit_count")


def _cache(t):
    cache = t.supplier.select(F.col("s_suppkey").cast("string").alias("lookup_key"), F.lit("old").alias("lookup_value"), F.lit(5).cast("long").alias("hit_count"), F.lit("2024-01-01").cast("timestamp").alias("expires_at"))
    writes = t.orders.select(F.col("o_custkey").cast("string").alias("lookup_key"), F.col("o_orderkey").cast("string").alias("lookup_value"), F.lit("2026-01-01").cast("timestamp").alias("expires_at"), F.col("o_orderkey").alias("ts"))
    return cache, writes


@reg.add("WITH w AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) SELECT c_custkey::VARCHAR AS lookup_key, v::VARCHAR AS lookup_value FROM customer LEFT JOIN w ON c_custkey = k")
def cache_get(t) -> DataFrame:
    cache = tables.cache_upsert(*_cache(t))
    return tables.cache_get(cache, t.customer.select(F.col("c_custkey").cast("string").alias("lookup_key")), F.lit("2025-01-01").cast("timestamp")).select("lookup_key", "lookup_value")


@reg.add("WITH w AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT count(*) AS lookups, count(k) AS hits, count(*) - count(k) AS misses, (SELECT count(*) FROM w) AS size FROM customer LEFT JOIN w ON c_custkey = k")
def cache_stats(t) -> DataFrame:
    keys = t.customer.select(F.col("c_custkey").alias("lookup_key"))
    return lookups.cache_stats(keys, t.orders.select(F.col("o_custkey").alias("lookup_key")).distinct())


@reg.add("SELECT event_id, domain FROM query_outcomes WHERE domain <> '_common'", "query_outcomes")
def teardown_domain(t) -> DataFrame:
    return tables.teardown(t.query_outcomes, "_common").select("event_id", "domain")


@reg.add(
    ", x AS (UNPIVOT (SELECT id, name, city, municipality FROM listings) ON name, city, municipality INTO NAME c VALUE v), r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY id) AS rank FROM x WHERE trim(v) <> '') SELECT c AS \"column\", rank, v AS value FROM r WHERE rank <= 50",
    "listings",
)
def sample_text_columns(t) -> DataFrame:
    return tables.sample_columns(t.listings, ["name", "city", "municipality"], "id")


@reg.add()
def discover_schema(t) -> DataFrame:
    return tables.describe_table(t.orders, "orders", "o_orderkey").unionByName(tables.describe_table(t.customer, "customer", "c_custkey"))


@reg.add()
def table_exists(t) -> DataFrame:
    t.customer.createOrReplaceTempView("customer")
    return t.region.select("r_name", F.lit(load.table_exists(t.spark, "customer")).alias("customer_there"))


COLS = "SELECT flag_type AS table_name, severity AS column_name, count(*) AS n FROM flags GROUP BY 1, 2"


def _columns(t) -> DataFrame:
    return t.flags.groupBy(F.col("flag_type").alias("table_name"), F.col("severity").alias("column_name")).agg(F.count("*").alias("n"))


@reg.add(f", c AS ({COLS}) SELECT table_name, column_name, n, CASE WHEN n % 2 = 0 THEN 'text' END AS role, CASE WHEN n % 3 = 0 THEN 'about ' || n END AS description FROM c", "flags")
def schema_with_profiles(t) -> DataFrame:
    c = _columns(t)
    profiles = c.where("n % 2 = 0").select("table_name", "column_name", F.lit("text").alias("role"))
    return tables.schema_with_profiles(c, profiles, c.where("n % 3 = 0").select("table_name", "column_name", F.concat(F.lit("about "), F.col("n")).alias("description")))


@reg.add(f", c AS ({COLS}) SELECT table_name, column_name, d.domain, CASE WHEN d.domain = 'b' THEN 'about ' || n END AS description FROM c, (SELECT unnest(['a', 'b']) AS domain) d", "flags")
def metadata_join(t) -> DataFrame:
    profiles = _columns(t).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("domain"))
    notes = profiles.where("domain = 'b'").select("domain", "table_name", "column_name", F.concat(F.lit("about "), F.col("n")).alias("description"))
    return profiles.join(notes, ["domain", "table_name", "column_name"], "left").select("table_name", "column_name", "domain", "description")


@reg.add(f", c AS ({COLS}) SELECT table_name, column_name FROM c WHERE n % 3 <> 0", "flags")
def list_annotation_gaps(t) -> DataFrame:
    c = _columns(t)
    return load.annotation_gaps(c, c.where("n % 3 = 0").withColumn("domain", F.lit("d")), "d").select("table_name", "column_name")


@reg.add(
    f", c AS ({COLS}) SELECT table_name, column_name, CASE WHEN n % 2 = 0 THEN 'old' ELSE coalesce(CASE WHEN n % 3 = 0 THEN 'new ' || n END, replace(column_name, '_', ' ')) END AS description, CASE WHEN n % 2 = 0 THEN 1::DOUBLE WHEN n % 3 = 0 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM c",
    "flags",
)
def apply_annotations(t) -> DataFrame:
    c = _columns(t)
    meta = c.where("n % 2 = 0").select("table_name", "column_name", F.lit("old").alias("description"), F.lit(1.0).alias("confidence"))
    results = c.where("n % 3 = 0").select("table_name", "column_name", F.concat(F.lit("new "), F.col("n")).alias("description"), F.lit(0.9).alias("confidence"))
    return load.apply_annotations(c.select("table_name", "column_name"), meta, results)


@reg.add(
    f", c AS ({COLS}), f AS (SELECT table_name FROM c WHERE n % 5 = 0) SELECT table_name, column_name, CASE WHEN n % 3 = 0 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM c WHERE n % 2 <> 0 AND table_name NOT IN (SELECT table_name FROM f)",
    "flags",
)
def low_annotations(t) -> DataFrame:
    """What is annotated at less than 0.70; tables whose annotation failed get nothing."""
    c = _columns(t)
    meta = c.where("n % 2 = 0").select("table_name", "column_name", F.lit("old").alias("description"), F.lit(1.0).alias("confidence"))
    results = c.where("n % 3 = 0").select("table_name", "column_name", F.lit("new").alias("description"), F.lit(0.6).alias("confidence"))
    applied = load.apply_annotations(c.select("table_name", "column_name"), meta, results, failed=c.where("n % 5 = 0").select("table_name"))
    return load.low_annotations(applied).select("table_name", "column_name", "confidence")


_LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@reg.add(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, {1 if n in ('customer', 'orders') else 0} AS score FROM {n}" for n in _LISTED) + ") WHERE table_name <> 'region'"
)
def diff_tables(t) -> DataFrame:
    """Given tables that aren't registered, with their rows, scored by the words of a request."""
    sizes = reduce(DataFrame.unionByName, [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in _LISTED])
    return load.score_tables(load.diff_tables(sizes, ["region"]), "clean the orders of customers")


@reg.add(
    r""", f AS (SELECT id, CASE WHEN municipality IS NULL THEN 'x | 1 | 2 | no id' ELSE '| ' || id || ' | ' || coalesce(postal_code, 'N/A') || ' | ' || coalesce(municipality, '') || ' | seen |' END AS line FROM listings)
SELECT id, CASE WHEN upper(postal_code) = 'N/A' THEN NULL ELSE postal_code END AS postal_code, CASE WHEN upper(municipality) IN ('N/A', '') THEN NULL ELSE municipality END AS municipality, 'seen' AS notes FROM listings WHERE municipality IS NOT NULL""",
    "listings",
)
def text_table_parse(t) -> DataFrame:
    line = F.expr("CASE WHEN municipality IS NULL THEN 'x | 1 | 2 | no id' ELSE concat('| ', id, ' | ', coalesce(postal_code, 'N/A'), ' | ', coalesce(municipality, ''), ' | seen |') END")
    block = t.listings.select(F.concat(F.lit("| id | postal | municipality | notes |\n|---|---|---|---|\n"), line).alias("reply"))
    return tables.parse_text_table(block, "reply")


@reg.add(
    ", m AS (SELECT fsa, min(normalized_municipality) AS n FROM fsa_map GROUP BY 1) SELECT id, n AS fsa_municipality, CASE WHEN coalesce(trim(postal_code), '') <> '' THEN CASE WHEN n IS NULL THEN 0::DOUBLE ELSE 0.95::DOUBLE END END AS fsa_confidence, coalesce(trim(postal_code), '') <> '' AND n IS NULL AS unknown_fsa FROM listings LEFT JOIN m ON fsa = upper(replace(postal_code, ' ', ''))[1:3]",
    "listings",
    "fsa_map",
)
def fsa_lookup(t) -> DataFrame:
    return lookups.fsa_lookup(t.listings, t.fsa_map).select("id", "fsa_municipality", "fsa_confidence", "unknown_fsa")


SQL_BOUNDARY = ", b AS (SELECT id, arg_min(normalized_municipality, (valid_from, normalized_municipality)) AS n FROM listings JOIN fsa_map ON fsa = upper(replace(postal_code, ' ', ''))[1:3] AND province = state_province AND fsa_map.country = 'CA' AND valid_from <= make_date(year, 1, 1) AND (valid_to IS NULL OR valid_to >= make_date(year, 12, 31)) GROUP BY 1)"


@reg.add(SQL_BOUNDARY + " SELECT listings.id, n AS boundary_municipality FROM listings LEFT JOIN b ON b.id = listings.id", "listings", "fsa_map")
def boundary_lookup(t) -> DataFrame:
    df = t.listings.withColumn("fsa", lookups.fsa_of("postal_code"))
    return lookups.boundary_lookup(df, t.fsa_map).select("id", "boundary_municipality")


@reg.add(
    ", m AS (SELECT city, state_province AS province, municipality, count(*) / 100.0::DOUBLE AS c FROM listings WHERE municipality IS NOT NULL AND city IS NOT NULL AND state_province IS NOT NULL GROUP BY ALL), b AS (SELECT city, province, arg_min(municipality, (-c, municipality)) AS n FROM m GROUP BY 1, 2) SELECT id, n AS city_municipality FROM listings l LEFT JOIN b ON b.city = l.city AND b.province = l.state_province",
    "listings",
)
def city_lookup(t) -> DataFrame:
    m = t.listings.where("municipality IS NOT NULL AND city IS NOT NULL AND state_province IS NOT NULL").groupBy("city", F.col("state_province").alias("province"), "municipality").agg((F.count("*") / 100.0).alias("confidence_score"))
    return lookups.city_lookup(t.listings, m).select("id", "city_municipality")


ADDRESS = ["address", "city", "postal_code", "municipality", "state_province", "country"]


@reg.add(
    "SELECT a.id, min(b.id) AS matched_id FROM listings a JOIN listings b ON " + " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ADDRESS) + " AND a.id <> b.id GROUP BY 1",
    "listings",
)
def null_safe_match(t) -> DataFrame:
    return lookups.null_safe_match(t.listings, t.listings, ADDRESS)


def _geocodes(t) -> DataFrame:
    from ..functions.text import geocode_key

    key = geocode_key("address", "city", "postal_code", "country", F.lit("ca"))
    day = F.expr("timestamp'2025-01-31 00:00:00' - make_dt_interval(CAST(id % 60 AS INT))")
    rows = t.listings.where("id % 2 = 0").select(key.alias("query_hash"), F.concat((F.col("id") % 90).cast("string"), F.lit(".5")).alias("lat"), F.lit("-79.4").alias("lon"), F.expr("CASE WHEN id % 4 = 0 THEN concat(city, ', Canada') ELSE 'Elsewhere' END").alias("display_name"), day.alias("fetched_at"), "id")
    return rows.groupBy("query_hash").agg(*[F.min_by(c, "id").alias(c) for c in ("lat", "lon", "display_name", "fetched_at")])


SQL_GEO = """, g AS (SELECT sha256(coalesce(address, '') || '|' || coalesce(city, '') || '|' || coalesce(postal_code, '') || '|' || coalesce(country, '') || '|ca')[1:32] AS h, arg_min((id % 90) || '.5', id) AS lat, arg_min(CASE WHEN id % 4 = 0 THEN city || ', Canada' ELSE 'Elsewhere' END, id) AS d, min(id) AS i FROM listings WHERE id % 2 = 0 GROUP BY 1),
v AS (SELECT l.*, g.lat, g.d FROM listings l LEFT JOIN g ON g.h = sha256(coalesce(address, '') || '|' || coalesce(city, '') || '|' || coalesce(postal_code, '') || '|' || coalesce(country, '') || '|ca')[1:32] AND i % 60 < 30)"""


@reg.add(
    SQL_GEO + " SELECT id, CASE WHEN coalesce(trim(address), '') <> '' OR coalesce(trim(postal_code), '') <> '' THEN lat END AS lat, CASE WHEN coalesce(trim(address), '') <> '' OR coalesce(trim(postal_code), '') <> '' THEN CASE WHEN d IS NULL THEN 0::DOUBLE WHEN trim(city) <> '' AND contains(lower(d), lower(city)) THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END END AS geocode_confidence FROM v",
    "listings",
)
def geocode_join(t) -> DataFrame:
    return lookups.geocode_join(t.listings, _geocodes(t), F.expr("timestamp'2025-01-31 00:00:00'")).select("id", "lat", "geocode_confidence")


@reg.add(
    SQL_GEO + """, m AS (SELECT fsa, min(normalized_municipality) AS n FROM fsa_map GROUP BY 1), r AS (SELECT v.*, m.n, CASE WHEN coalesce(trim(address), '') <> '' OR coalesce(trim(postal_code), '') <> '' THEN d IS NOT NULL AND trim(city) <> '' AND contains(lower(d), lower(city)) END AS sure FROM v LEFT JOIN m ON fsa = substr(upper(replace(postal_code, ' ', '')), 1, 3))
SELECT id, CASE WHEN n IS NOT NULL THEN 'cache' WHEN sure THEN 'geocode' ELSE 'review' END AS resolved_by, CASE WHEN n IS NOT NULL THEN n WHEN sure THEN city ELSE nullif(municipality, '') END AS resolved_municipality, CASE WHEN n IS NOT NULL THEN 0.95::DOUBLE WHEN sure THEN 0.9::DOUBLE ELSE 0::DOUBLE END AS resolved_confidence FROM r""",
    "listings", "fsa_map",
)
def resolve_municipality(t) -> DataFrame:
    df = lookups.boundary_lookup(lookups.fsa_lookup(t.listings, t.fsa_map), t.fsa_map)
    df = lookups.geocode_join(df, _geocodes(t), F.expr("timestamp'2025-01-31 00:00:00'"))
    return lookups.resolve_municipality(df).select("id", "resolved_by", "resolved_municipality", "resolved_confidence")


@reg.add("SELECT flag_type, severity, count(*) AS n, count(*) FILTER (resolved_at IS NULL) AS unresolved FROM flags GROUP BY 1, 2", "flags")
def flag_summary(t) -> DataFrame:
    return lookups.flag_summary(t.flags)


SCORED = "(coalesce(correctness, 0.5) + coalesce(format, 0.5) + coalesce(instruction_following, 0.5)) / 3.0"


@reg.add(f"SELECT test_case_id, {SCORED} AS overall, CASE WHEN {SCORED} >= 0.8 THEN 'pass' WHEN {SCORED} >= 0.5 THEN 'partial' ELSE 'fail' END AS verdict FROM judge_scores", "judge_scores")
def score_case(t) -> DataFrame:
    return lookups.score_cases(t.judge_scores).select("test_case_id", "overall", "verdict")


@reg.add(
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(avg({d}), 3) AS mean, round(min({d}), 3) AS least, round(max({d}), 3) AS most, count({d}) AS n FROM judge_scores" for d in ("correctness", "format", "instruction_following")),
    "judge_scores",
)
def eval_summary(t) -> DataFrame:
    return lookups.eval_summary(t.judge_scores)


_JUDGE = """, q AS (SELECT test_case_id, user AS u, correctness AS c, format AS f, instruction_following AS i FROM (SELECT *, test_case_id % 7 AS user FROM judge_scores)),
x AS (SELECT *, CASE WHEN u IN (5, 6) THEN 0.5::DOUBLE ELSE c END AS c2, CASE WHEN u IN (1, 5, 6) THEN 0.5::DOUBLE ELSE f END AS f2, CASE WHEN u IN (5, 6) THEN 0.5::DOUBLE ELSE i END AS i2 FROM q), m AS (SELECT *, (c2 + f2 + i2) / 3.0::DOUBLE AS mean FROM x),
j AS (SELECT *, CASE WHEN u IN (5, 6) THEN 'partial' WHEN u = 2 THEN 'fail' WHEN mean >= 0.8 THEN 'pass' WHEN mean >= 0.5 THEN 'partial' ELSE 'fail' END AS verdict FROM m)"""


def _judged(t) -> DataFrame:
    """A judge's answers: plain, without a score, with its own verdict, fenced, within a sentence, unreadable, and none."""
    kind = F.col("test_case_id") % 7
    scores = F.struct("correctness", F.when(kind != 1, F.col("format")).alias("format"), "instruction_following").alias("dimensions")
    told = F.to_json(F.struct(scores, F.when(kind == 2, "fail").alias("overall_verdict")))
    raw = F.when(kind == 3, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).when(kind == 4, F.concat(F.lit("I say "), told, F.lit(" and that is it"))).when(kind == 5, "no answer at all").when(kind != 6, told)
    return lookups.score_judgements(t.judge_scores.select("test_case_id", raw.alias("raw"), F.array(F.lit("be right")).alias("criteria"), F.lit(None).cast("string").alias("error")))


@reg.add(_JUDGE + " SELECT test_case_id, round(mean, 3) AS overall, verdict, u IN (5, 6) AS failed, CASE WHEN u IN (5, 6) THEN 0 ELSE 1 END AS criteria, CASE WHEN u NOT IN (5, 6) THEN mean >= 0.5 END AS passed FROM j", "judge_scores")
def judge_answers(t) -> DataFrame:
    return _judged(t).select("test_case_id", "overall", "verdict", F.col("judge_error").isNotNull().alias("failed"), F.size("criteria_results").alias("criteria"), F.get("criteria_results", F.lit(0))["pass"].alias("passed"))


@reg.add(_JUDGE + " SELECT v AS verdict, (SELECT count(*) FROM j WHERE verdict = v) AS n FROM (VALUES ('pass'), ('partial'), ('fail')) AS t(v)", "judge_scores")
def verdict_counts(t) -> DataFrame:
    return lookups.verdict_counts(_judged(t))


SQL_MEMORY = "SELECT domain, gap_type, query_template, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, max(ts) AS last_used_at FROM query_outcomes GROUP BY 1, 2, 3"


@reg.add(SQL_MEMORY, "query_outcomes")
def query_outcomes(t) -> DataFrame:
    return lookups.query_outcomes(t.query_outcomes)


@reg.add(
    "SELECT domain, url_host, round(list_reduce(list(CASE WHEN success THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END ORDER BY ts, event_id), lambda s, x: least(1::DOUBLE, greatest(0::DOUBLE, s + x)), 0.5::DOUBLE), 6) AS trust_score FROM query_outcomes GROUP BY 1, 2",
    "query_outcomes",
)
def source_trust(t) -> DataFrame:
    return lookups.source_trust(t.query_outcomes, ["ts", "event_id"])


@reg.add(
    f", m AS ({SQL_MEMORY}), r AS (SELECT *, success_count / (success_count + failure_count) AS s FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY domain, gap_type ORDER BY s DESC, success_count DESC, query_template) AS rank FROM r) SELECT domain, gap_type, rank, query_template, success_count, round(s, 6) AS success_rate FROM k WHERE rank <= 3",
    "query_outcomes",
)
def top_queries(t) -> DataFrame:
    return lookups.top_queries(lookups.query_outcomes(t.query_outcomes))


@reg.add(
    f", m AS ({SQL_MEMORY}), r AS (SELECT *, success_count / (success_count + failure_count) AS s FROM m WHERE domain <> 'sports_ticketing'), k AS (SELECT *, row_number() OVER (PARTITION BY domain, gap_type ORDER BY s DESC, success_count DESC, query_template) AS rank FROM r)"
    " SELECT CASE WHEN domain = '_common' THEN 'sports_ticketing' ELSE domain END AS domain, gap_type, rank, query_template FROM k WHERE rank <= 2",
    "query_outcomes",
)
def top_queries_with_fallback(t) -> DataFrame:
    wanted = t.query_outcomes.where("domain <> '_common'").select("domain", "gap_type").distinct()
    memory = lookups.query_outcomes(t.query_outcomes.where("domain <> 'sports_ticketing'"))
    return lookups.with_fallback(lookups.top_queries(memory, 2), wanted).select("domain", "gap_type", "rank", "query_template")


@reg.add(", f AS (SELECT id FROM listings ORDER BY municipality_confidence NULLS FIRST, id LIMIT 100) SELECT id, id IN (SELECT id FROM f) AS granted FROM listings", "listings")
def budget_gate(t) -> DataFrame:
    return lookups.budget_gate(t.listings, 100, [F.asc_nulls_first("municipality_confidence"), F.asc("id")]).select("id", "granted")


@reg.add(
    ", x AS (SELECT raw_data_id AS id, id % 4 AS gap_pos, row_number() OVER (PARTITION BY raw_data_id, id % 4 ORDER BY id) AS rank FROM flags), q AS (SELECT id, gap_pos, rank, row_number() OVER (PARTITION BY id ORDER BY gap_pos, rank) AS query_no FROM x WHERE rank <= 2) SELECT * FROM q WHERE query_no <= 3",
    "flags",
)
def per_record_query_cap(t) -> DataFrame:
    from pyspark.sql import Window

    asked = t.flags.select(F.col("raw_data_id").alias("id"), (F.col("id") % 4).alias("gap_pos"), F.row_number().over(Window.partitionBy("raw_data_id", F.col("id") % 4).orderBy("id")).alias("rank"))
    return lookups.cap_queries(asked)


@reg.add(
    "SELECT a.vec_id AS query_id, arg_max(b.vec_id, (list_cosine_similarity(a.embedding, b.embedding), -b.vec_id)) AS vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) > 0.15 GROUP BY 1"
)
def semantic_cache_lookup(t) -> DataFrame:
    return vectors.nearest_within(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, 0.15).select("query_id", "vec_id")


@reg.add(
    "SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 3"
)
def address_topk(t) -> DataFrame:
    return vectors.topk_cosine(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, 3).select("query_id", "vec_id", "rank")


_WORDS = r"[x FOR x IN list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) IF length(x) >= 4]"


@reg.add(
    f""", d AS (SELECT vec_id, lang AS domain, 0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE AS confidence, {_WORDS} AS terms, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.e, d.e) AS c, (0.5::DOUBLE * list_cosine_similarity(q.e, d.e) + 0.5::DOUBLE * len(list_intersect(q.terms, d.terms)) / greatest(1, len(q.terms))) * d.confidence AS score
  FROM d q JOIN d ON q.vec_id % 100 = 0 AND q.domain = d.domain AND q.vec_id <> d.vec_id)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE c > 0.05) WHERE rank <= 5"""
)
def hybrid_retrieve(t) -> DataFrame:
    """Patterns are documents with vectors: their language is the domain, and their length gives a confidence."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"))), lambda w: F.length(w) >= 4)
    sure = F.lit(0.5) + (F.col("n_chars") % 50) / F.lit(100.0)
    known = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("vec_id", "embedding", F.col("lang").alias("domain"), sure.alias("confidence"), words.alias("terms"))
    index = retrieval.build_index(known)
    return retrieval.hybrid_retrieve(known.where("vec_id % 100 = 0"), index, least_cosine=0.05).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@reg.add(
    ", s AS (SELECT id, address, city, 'old' AS note FROM listings WHERE phone IS NOT NULL), r AS (SELECT max(id) AS id, address, city FROM listings WHERE phone IS NULL AND coalesce(address, '') <> '' GROUP BY address, city) SELECT coalesce(s.address, r.address) AS address, coalesce(s.city, r.city) AS city, CASE WHEN r.id IS NOT NULL THEN 'new' ELSE 'old' END AS note, count(*) AS n FROM s FULL JOIN r ON s.address IS NOT DISTINCT FROM r.address AND s.city IS NOT DISTINCT FROM r.city GROUP BY ALL",
    "listings",
)
def address_upsert(t) -> DataFrame:
    rows = t.listings.where("phone IS NULL").select("id", "address", "city", F.lit("new").alias("note"))
    out = vectors.address_upsert(t.listings.where("phone IS NOT NULL").select("address", "city", F.lit("old").alias("note")), rows, ["address", "city"], ["note"], "id")
    return out.groupBy("address", "city", "note").agg(F.count("*").alias("n"))

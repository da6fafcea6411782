"""Text cleaning as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col, is_blank

# Word expansions, matched at word boundaries in any case, in this order.
QUADRANTS = {"NE": "Northeast", "NW": "Northwest", "SE": "Southeast", "SW": "Southwest"}
STREET_TYPES = {
    "st": "Street", "ave": "Avenue", "avenue": "Avenue", "blvd": "Boulevard", "rd": "Road", "lane": "Lane", "ln": "Lane", "dr": "Drive",
    "ct": "Court", "ctr": "Center", "pk": "Park", "pkwy": "Parkway", "ter": "Terrace", "pl": "Place", "sq": "Square",
}
TRAILING_TYPES = {"St": "Street", "Ave": "Avenue", "Blvd": "Boulevard", "Rd": "Road", "Dr": "Drive", "Ln": "Lane", "Pl": "Place", "Cir": "Circle", "Ct": "Court", "Terr": "Terrace"}
# Team names and what is meant; patterns of product names in order.
TEAM_ALIASES = {
    "leafs": "toronto maple leafs", "maple leafs": "toronto maple leafs", "toronto leafs": "toronto maple leafs", "habs": "montreal canadiens",
    "canadiens": "montreal canadiens", "sens": "ottawa senators", "senators": "ottawa senators", "jets": "winnipeg jets", "flames": "calgary flames",
    "oilers": "edmonton oilers", "canucks": "vancouver canucks", "jays": "toronto blue jays", "blue jays": "toronto blue jays", "raptors": "toronto raptors",
}
PRODUCT_PATTERNS = {
    "full_season": r"\bfull[\s-]?season\b|\b82[\s-]?game\b|\b38[\s-]?game\b",
    "half_season": r"\bhalf[\s-]?season\b|\b41[\s-]?game\b|\b19[\s-]?game\b",
    "voucher": r"\bvoucher\b|\bflex\b|\bcredit\b|\bgift\b",
    "individual": r"\bsingle[\s-]?game\b|\bindividual\b|\b1[\s-]?game\b|\bone[\s-]?game\b",
}


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_case(c: str | Column) -> Column:
    """A capital after anything that isn't a letter, small letters otherwise: O'Brien, 33Rd."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def standardize_address(c: str | Column, strip_units: bool = False) -> Column:
    """Quadrants and street types as words, white space as one space; single-letter directions stay."""
    out = col(c)
    if strip_units:
        out = F.regexp_replace(out, r"(?i),?\s*(apt|apt\.|unit|unit\.|#)\s*\w+", "")
    for short, word in {**QUADRANTS, **STREET_TYPES}.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", word)
    return one_space(out)


def address_cache_key(c: str | Column) -> Column:
    """An address without house number, what follows a comma, and dots; title case, its last word expanded."""
    out = F.regexp_replace(F.trim(col(c)), r"^\d+\s+", "")
    out = title_case(F.regexp_replace(F.regexp_replace(F.trim(F.split_part(out, F.lit(","), F.lit(1))), "[.,]", ""), r"\s+", " "))
    for short, word in TRAILING_TYPES.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\.?$", word)
    first = F.regexp_extract(out, r"^([nNsSeEwW]{1,2})\s", 1)
    out = F.when(first != "", F.concat(F.upper(first), F.lit(" "), out.substr(F.length(first) + 2, F.length(out)))).otherwise(out)
    return F.coalesce(F.trim(out), F.lit(""))


def normalize_search_query(c: str | Column) -> Column:
    return F.regexp_replace(one_space(F.lower(col(c))), r"[.,;:!?]+$", "")


def team_name(c: Column, aliases: dict[str, str] = TEAM_ALIASES) -> Column:
    """The canonical name of an alias, else the trimmed text."""
    key = F.lower(F.trim(c))
    return reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), reversed(aliases.items()), F.trim(c))


def sides_of(c: str | Column) -> tuple[Column, Column]:
    """The two sides of an event's name; empty if it has none."""
    pattern = r"(?i)^(.+?)\s+(?:vs\.?|@|at)\s+(.+)$"
    return F.regexp_extract(F.trim(col(c)), pattern, 1), F.regexp_extract(F.trim(col(c)), pattern, 2)


def normalize_event_name(c: str | Column, aliases: dict[str, str] = TEAM_ALIASES) -> Column:
    """'A vs B' with canonical names, from A (vs, vs., @, at) B; other texts stay. Equal up to case: stays."""
    left, right = sides_of(c)
    new = F.concat(team_name(left, aliases), F.lit(" vs "), team_name(right, aliases))
    return F.when((left != "") & (F.lower(new) != F.lower(col(c))), new).otherwise(col(c))


def product_category(name: str | Column, kind: str | Column, existing: str | Column) -> tuple[Column, Column]:
    """(category, confidence): an existing one stays, blank texts give none, no pattern is individual at 0.50."""
    text = F.coalesce(F.nullif(col(name), F.lit("")), F.nullif(col(kind), F.lit("")))
    found = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), k) for k, p in PRODUCT_PATTERNS.items()])
    new = text.isNotNull() & F.coalesce(col(existing) == "", F.lit(True))
    return (
        F.when(new, F.coalesce(found, F.lit("individual"))).otherwise(col(existing)),
        F.when(new, F.when(found.isNull(), 0.50).otherwise(0.85)),
    )


def url_host(c: str | Column) -> Column:
    """What stands between :// and the next slash, question mark or hash, port included; lower case as it is."""
    return F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def geocode_key(street, city, postal, country, code) -> Column:
    """The first 32 hex digits of the SHA-256 of the fields joined by bars; null as empty."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (street, city, postal, country, code)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def embedding_text(*fields: str) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(col(f), F.lit("")) for f in fields])


def fill_template(template: str | Column, fields: dict[str, str | Column]) -> Column:
    """{field} replaced by the record's values; null if a field is blank or unknown."""
    out = reduce(lambda t, f: F.replace(t, F.lit("{" + f + "}"), F.when(~is_blank(fields[f]), col(fields[f]).cast("string")).otherwise("{" + f + "}")), fields, col(template))
    return F.when(~out.rlike(r"\{\w+\}"), out)


def values_of(fields: list[str]) -> Column:
    """A map of a record's fields that aren't blank, as text, for ``fill_from``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), col(f).cast("string").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: ~is_blank(p["value"])))


def fill_from(template: Column, values: Column) -> Column:
    """{field} replaced by what a map has for it; null if it lacks a field. The expression's size doesn't depend on the fields."""
    parts = F.arrays_zip(F.split(template, r"\{\w+\}").alias("text"), F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1).alias("name"))
    return F.aggregate(parts, F.lit(""), lambda s, p: F.concat(s, p["text"], F.when(p["name"].isNull(), "").otherwise(F.element_at(values, p["name"]))))


def extract_json(c: str | Column) -> Column:
    """The JSON object in a free text: a fenced block, else from the last brace that opens one; null if none parses."""
    fenced = F.regexp_extract(col(c), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    tail = F.regexp_extract(col(c), r"(?s)(\{[^{}]*\})[^{}]*$", 1)
    whole = F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    tried = [F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in (fenced, whole, tail)]
    return F.coalesce(*tried)

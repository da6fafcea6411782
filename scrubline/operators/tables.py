"""Table upkeep: filtered reads, insert-ignore, upsert, guarded updates and deletes, caches, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import violations
from ..functions.missing import filled, is_blank


def query_rows(df: DataFrame, filters: dict[str, object], limit: int = 50, order_by: str = "id") -> DataFrame:
    """Rows that equal all filters, the first ``limit`` by ``order_by``; an unknown column is an error."""
    unknown = sorted({*filters, order_by} - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return reduce(lambda d, f: d.where(F.col(f[0]) == F.lit(f[1])), filters.items(), df).orderBy(order_by).limit(limit)


def _one_per_key(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key: an aggregate, so that partitions combine first. Of equal order the least (greatest) row."""
    cols = [c for c in rows.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in cols])
    pick = (F.max if last else F.min)(F.struct(F.col(order).alias("o"), whole.alias("r")))["r"].alias("_r")
    return rows.groupBy(*keys).agg(pick).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows whose key target doesn't have; of rows with one key the first by ``order``."""
    return _one_per_key(rows, keys, order).join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target and the rows whose key it doesn't have; of rows with one key the first by ``order``, which isn't kept."""
    return target.unionByName(new_rows(target, rows, keys, order).select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str], order: str) -> DataFrame:
    """target with ``update`` columns overwritten by rows of the same key, and the other rows added; the last by ``order`` counts."""
    new = _one_per_key(rows, keys, order, last=True).select(*target.columns).withColumn("_new", F.lit(True)).alias("n")
    old = target.withColumn("_old", F.lit(True)).alias("o")
    on = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = old.join(new, on, "full_outer")
    take_new = F.col("_new").isNotNull()
    return both.select(*[F.when(take_new if c in update else F.col("_old").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in target.columns])


def uncleaned_only(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    return raw.join(cleaned.select(F.col("raw_data_id").alias("id")), "id", "left_anti")


#: Words of a request -> country.
SCOPES = {"canadian": "CA", "canada": "CA", "american": "US", "usa": "US", "united states": "US", "dutch": "NL", "netherlands": "NL", "mexican": "MX", "mexico": "MX", "japanese": "JP", "japan": "JP"}


def scope_filter(text: str) -> dict[str, object]:
    """{country, limit} of a request in words: no country if none or several are named; 'first' gives a limit of 5."""
    low = f" {text.lower()} "
    named = {code for word, code in SCOPES.items() if f" {word} " in low}
    return {"country": named.pop() if len(named) == 1 else None, "limit": 5 if " first " in low else None}


def merge_results(raw: DataFrame, outputs: DataFrame, fields: list[str]) -> DataFrame:
    """raw with ``fields`` overwritten where outputs (by id) has text, and notes of what was changed before and then."""
    out = outputs.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.col("validation_notes").alias("_notes"))
    notes = F.concat_ws(" | ", F.when(F.size("pre_changes") > 0, F.concat(F.lit("Pre-cleaned: "), F.array_join("pre_changes", "; "))), filled("_notes"))
    both = raw.join(out, "id", "left")
    return both.select(*[F.coalesce(filled(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in raw.columns], notes.alias("validation_notes"))


def exploded(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A table of its own of an array of structs or texts: ``keep`` and the element."""
    return df.select(*keep, F.explode(column).alias("entry")).select(*keep, "entry.*") if df.schema[column].dataType.elementType.typeName() == "struct" else df.select(*keep, F.explode(column).alias(column))


def persist(cleaned: DataFrame, out_dir: str, run_id: str) -> None:
    """Write cleaned rows, audit rows and flag rows of a run as three tables; ``cleaned`` has audit and flags arrays."""
    held = cleaned.withColumn("run_id", F.lit(run_id)).persist()
    held.drop("audit", "flags").write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/cleaned")
    exploded(held, "audit", "id", "run_id").write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/audit")
    exploded(held, "flags", "id", "run_id").write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/flags")
    held.unpersist()


PROTECTED = ("id", "raw_data_id", "imported_at", "cleaned_at")


def update_fields(df: DataFrame, updates: DataFrame, fields: list[str], rejects: Column) -> tuple[DataFrame, DataFrame]:
    """(updated, rejected): updates (id and new values, null leaves a field) on rows by id; ``rejects`` is an array of
    reasons over the row as it would be. Protected fields and unknown ids are rejected too."""
    bad = sorted(set(fields) & set(PROTECTED))
    if bad or not fields:
        raise ValueError(f"cannot update: {', '.join(bad) or 'no field given'}")
    new = updates.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_asked"))
    both = df.join(new, "id", "left").withColumns({f"_was_{f}": F.col(f) for f in fields})
    both = both.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).withColumn("_why", F.when(F.col("_asked"), rejects))
    refused = F.coalesce(F.size("_why") > 0, F.lit(False))
    done = both.select(*[F.when(refused, F.col(f"_was_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])
    return done, both.where(refused).select("id", F.col("_why").alias("reasons"))


def update_reasons(fields: list[str]) -> Column:
    """What keeps an update from being written, for ``update_fields``: only given values are checked, state and phone by the
    country as it would be."""
    asked = lambda f: F.coalesce(F.col(f"_{f}").cast("string"), F.lit("")) != "" if f in fields else F.lit(False)
    told = violations()
    by = {"age": ("age",), "country": ("country",), "state_province": ("state_abbreviation", "state_unknown"), "phone": ("nl_phone",)}
    wanted = F.array_compact(F.array(*[F.when(asked(f), n) for f, names in by.items() for n in names]))
    return F.array_intersect(told, wanted)


def delete_guarded(df: DataFrame, cleaned: DataFrame, deletes: DataFrame) -> DataFrame:
    """df without the rows whose delete (id, confirm, override) is confirmed by 'yes', and not of a cleaned row unless overridden."""
    used = cleaned.select(F.col("raw_data_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    allowed = deletes.where("id > 0 AND confirm = 'yes'").join(used, "id", "left").where("_used IS NULL OR override")
    return df.join(allowed.select("id"), "id", "left_anti")


def resolve_flags(flags: DataFrame, resolutions: DataFrame) -> DataFrame:
    """resolved_at, resolved_by and resolution_note set where a flag isn't resolved yet; resolutions: (id, at, by, note)."""
    both = flags.join(resolutions.select("id", *[F.col(c).alias(f"_{c}") for c in ("at", "by", "note")]), "id", "left")
    take = F.col("resolved_at").isNull() & F.col("_at").isNotNull()
    return both.select(*[c for c in flags.columns if c != "resolved_at"], F.when(take, F.col("_at")).otherwise(F.col("resolved_at")).alias("resolved_at"), F.when(take, F.col("_by")).alias("resolved_by"), F.when(take, F.col("_note")).alias("resolution_note"))


def query_flags(flags: DataFrame, unresolved: bool = False, raw_data_id: int | None = None, flag_type: str | None = None, limit: int = 100) -> DataFrame:
    """The newest flags, at most ``limit`` of them."""
    out = flags.where("resolved_at IS NULL") if unresolved else flags
    out = out.where(F.col("raw_data_id") == raw_data_id) if raw_data_id is not None else out
    out = out.where(F.col("flag_type") == flag_type) if flag_type else out
    return out.orderBy(F.desc("raised_at"), "id").limit(limit)


def record_history(audit: DataFrame, raw_data_id: int) -> DataFrame:
    return audit.where(F.col("raw_data_id") == raw_data_id).orderBy("raised_at", "id")


def cache_upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """cache (lookup_key, lookup_value, hit_count, expires_at) after writes (lookup_key, lookup_value, expires_at, ts):
    the last write's value and expiry; a new key starts at 0 hits, each further write adds one."""
    new = writes.groupBy("lookup_key").agg(F.max_by(F.struct("lookup_value", "expires_at"), "ts").alias("w"), F.count("*").alias("n"))
    both = cache.alias("c").join(new.alias("n"), "lookup_key", "full_outer")
    wrote = F.col("n.n").isNotNull()
    hits = F.when(F.col("c.hit_count").isNull(), F.col("n.n") - 1).otherwise(F.col("c.hit_count") + F.coalesce("n.n", F.lit(0)))
    return both.select("lookup_key", *[F.when(wrote, F.col(f"n.w.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in ("lookup_value", "expires_at")], hits.alias("hit_count"))


def cache_get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys (lookup_key) with the values that haven't expired."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("lookup_key", "lookup_value", "hit_count")
    return keys.join(live, "lookup_key", "left")


def teardown(df: DataFrame, domain: str) -> DataFrame:
    return df.where(F.col("domain") != domain)


def sample_columns(df: DataFrame, columns: list[str], order: str, n: int = 50) -> DataFrame:
    """(column, rank, value): the first n different-row values that aren't empty of each text column, in one pass."""
    long = df.select(order, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(order, "x.*").where(~is_blank("value"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(order))
    return long.withColumn("rank", rank).where(F.col("rank") <= n).select("column", "rank", "value")


def describe_table(df: DataFrame, table: str, key: str | None = None) -> DataFrame:
    """(table_name, column_name, position, type, is_key) of a DataFrame's schema."""
    rows = [(table, f.name, i, f.dataType.simpleString(), f.name == key) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, position int, type string, is_key boolean")


def schema_with_profiles(columns: DataFrame, profiles: DataFrame, metadata: DataFrame) -> DataFrame:
    return columns.join(profiles, ["table_name", "column_name"], "left").join(metadata, ["table_name", "column_name"], "left")


def format_rows(df: DataFrame) -> DataFrame:
    """(id, line): records as lines of a text table, with what is missing."""
    issues = F.concat_ws("; ", F.when(is_blank("municipality"), "municipality missing"), F.when(F.length(F.coalesce(F.trim("postal_code"), F.lit(""))) < 5, "postal missing/incomplete"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "address", "city", "postal_code", "municipality", "state_province", "country")]
    return df.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells, issues), F.lit(" |")).alias("line"))


def parse_text_table(df: DataFrame, column: str) -> DataFrame:
    """(id, postal_code, municipality, notes) of lines '| id | postal | municipality | notes |'; N/A and empty as null, the last line of an id counts."""
    lines = df.select(F.posexplode(F.split(column, "\n")).alias("pos", "line")).where("line LIKE '|%' AND NOT line RLIKE '^[|\\\\s:-]+$'")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\|\s*|\s*\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select("pos", cells.alias("c")).where("size(c) >= 3").withColumn("id", F.expr("try_cast(c[0] AS LONG)")).where("id IS NOT NULL")
    value = lambda i: F.expr(f"CASE WHEN upper(get(c, {i})) IN ('N/A', '') THEN NULL ELSE get(c, {i}) END")
    rows = rows.select("id", "pos", value(1).alias("postal_code"), value(2).alias("municipality"), F.coalesce(F.expr("get(c, 3)"), F.lit("")).alias("notes"))
    return _one_per_key(rows, ["id"], "pos", last=True).drop("pos")

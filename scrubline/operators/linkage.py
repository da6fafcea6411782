"""Entity linkage: candidate pairs by block, match rules, fuzzy similarity, groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


@dataclass(frozen=True)
class Rule:
    """exact: all fields equal, lower-cased and trimmed; fuzzy: the joined fields' similarity reaches the threshold."""

    name: str
    fields: tuple[str, ...]
    kind: str = "exact"
    threshold: float = 0.85
    weight: float = 1.0


RULES = (Rule("email", ("email",), weight=1.0), Rule("address", ("address", "city"), "fuzzy", 0.9, 0.9))


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def bigrams(c: Column) -> Column:
    """The set of a text's pairs of characters; a text of one character is its own."""
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of the bigram sets, half one less the edit distance over the longer length; equal texts 1, an empty one 0."""
    x, y = bigrams(a), bigrams(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, F.when(a == "", 0.0).otherwise(1.0)).when((a == "") | (b == ""), 0.0).otherwise(0.5 * jaccard + 0.5 * edit)


def blocks_of(df: DataFrame, blocks: list[str]) -> DataFrame:
    """(id, blocks..., first_id, partners): each record's block by its least id, and how many others it may be matched with.

    Null values form no block, so such records are left out. A block of n records stands for its n (n - 1) / 2 pairs.
    """
    sizes = df.groupBy(*blocks).agg(F.min("id").alias("first_id"), (F.count("*") - 1).alias("partners"))
    return df.select("id", *blocks).join(sizes, blocks)


def _given(rule: Rule) -> Column:
    """Are all fields of a rule there? A rule with an empty field is skipped."""
    out = F.lit(True)
    for f in rule.fields:
        out = out & (_norm(f) != "")
    return out


def _texts(df: DataFrame, blocks: list[str], rule: Rule) -> DataFrame:
    """(blocks..., id, x): a fuzzy rule's joined text."""
    return df.where(_given(rule)).select(*blocks, "id", F.concat_ws(" ", *[_norm(f) for f in rule.fields]).alias("x"))


def _bits(grams: Column) -> Column:
    """64 bits of a set of bigrams, each of which sets one: sets differ in as many members as their bits differ, or in more."""
    return F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))


def _edits(least: float, n: Column, length: Column) -> Column:
    """How many of a text's n bigrams another may lack if the similarity can still be ``least``; an edit takes two of them, or lengthens the other text."""
    told = F.filter(F.sequence(F.lit(0), n), lambda d: (n - d) / n + length / (length + F.ceil(d / F.lit(2))) >= 2 * least - 1e-9)
    return F.greatest(F.size(told) - 1, F.lit(0))


def _may_reach(least: float, common: Column) -> Column:
    """May texts with at most ``common`` equal bigrams reach a similarity of ``least``? An edit changes at most four members of the sets."""
    both, longer = F.col("size_a") + F.col("size_b"), F.greatest("length_a", "length_b")
    edits = F.greatest(F.ceil((both - 2 * common) / F.lit(4)), F.abs(F.col("length_a") - F.col("length_b")))
    return common / (both - common) + (1 - edits / longer) >= 2 * least - 1e-9


def similar_texts(texts: DataFrame, blocks: list[str], threshold: float) -> DataFrame:
    """(blocks..., x_a, x_b, similarity), x_a < x_b, of distinct texts (blocks..., x) in one block whose similarity reaches the threshold.

    With a text's bigrams in order of rarity in their block, those that another text may lack are bounded, by the Jaccard and
    the edit part together, and one of the first ones, one more than that, is shared. So only texts that share a rare bigram
    meet, at the first one they share, at sizes and places and with bits that leave room for enough common ones. Bigrams are
    numbers, and the similarity is counted from them. If the threshold is 0.5 or less, texts without a common bigram are left out.
    """
    code = lambda g: F.ascii(g).cast("long") * (1 << 21) + F.ascii(F.substring(g, 2, 1)) + (F.length(g) > 1).cast("int")
    # both sides of the join read these tables, so they are made once
    texts = written(texts.where("x <> ''").dropna(subset=blocks).withColumn("grams", F.transform(bigrams(F.col("x")), code)), "texts")
    grams = texts.select(*blocks, "x", F.explode("grams").alias("g"))
    counts = grams.groupBy(*blocks, "g").agg(F.count("*").alias("n"))
    ranked = grams.join(counts, [*blocks, "g"]).groupBy(*blocks, "x").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    ranked = ranked.select(*blocks, "x", F.transform("gs", lambda g: g["g"]).alias("gs"), F.size("gs").alias("size"), F.length("x").alias("length"))
    ranked = written(ranked.withColumns({"bits": _bits(F.col("gs")), "first": F.least("size", _edits(threshold, F.col("size"), F.col("length")) + 1)}), "ranked")
    discard(texts)
    keyed = ranked.select(*blocks, "x", "gs", "size", "length", "bits", F.posexplode(F.slice("gs", F.lit(1), F.col("first"))).alias("at", "g"))
    a, b = (keyed.select(*blocks, "g", *[F.col(c).alias(f"{c}_{s}") for c in ("x", "gs", "size", "length", "bits", "at")]) for s in "ab")
    # common ones: this one and those behind it, and no more than the bits say
    behind = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    room = F.least(behind, F.floor((F.col("size_a") + F.col("size_b") - apart) / F.lit(2)).cast("int"))
    pairs = a.join(b, [*blocks, "g"]).where("x_a < x_b").where(_may_reach(threshold, room))
    pairs = pairs.where(~F.arrays_overlap(F.slice("gs_a", F.lit(1), F.col("at_a")), F.slice("gs_b", F.lit(1), F.col("at_b"))))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("gs_a", "gs_b"))).where(_may_reach(threshold, F.col("common")))
    jaccard = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    edit = 1 - F.levenshtein("x_a", "x_b") / F.greatest("length_a", "length_b")
    return pairs.select(*blocks, "x_a", "x_b", (0.5 * jaccard + 0.5 * edit).alias("similarity")).where(F.col("similarity") >= threshold)


@dataclass(frozen=True)
class Classes:
    """Matches in factors: members (rule, class_id, id, side) and pairs (rule, class_a, class_b, confidence, records_a, records_b,
    others_a, others_b), class_a <= class_b.

    A class is the rows of a block that are equal to a rule, by its fields or its text, and is named by its least id. A pair
    of a class with itself stands for all pairs inside it, one of two classes for all between them. Side 1 are the others.
    """

    members: DataFrame
    pairs: DataFrame


def match_classes(df: DataFrame, others: DataFrame | None, blocks: list[str], rules: tuple[Rule, ...] = RULES) -> Classes:
    """What ``rules`` match in blocks of df, or between df and ``others``: as many members as rows, and pairs of different texts only.

    A rule with an empty field is skipped, null block values match nothing. A pair of rows that several rules match is in
    each of them, and belongs to the first (``expanded``).
    """
    members = pairs = None
    for r in rules:
        text = F.concat_ws(" " if r.kind == "fuzzy" else "\x1f", *[_norm(f) for f in r.fields]).alias("x")
        sides = [d.where(_given(r)).select(*blocks, "id", text, F.lit(s).alias("side")) for s, d in enumerate((df, others)) if d is not None]
        rows = (sides[0] if others is None else sides[0].unionByName(sides[1])).dropna(subset=blocks)
        classes = rows.groupBy(*blocks, "x").agg(F.min("id").alias("class_id"), F.count_if(F.col("side") == 0).alias("records"), F.count_if(F.col("side") == 1).alias("others"))
        classes = written(classes, "classes")
        own = rows.join(classes, [*blocks, "x"]).select(F.lit(r.name).alias("rule"), "class_id", "id", "side")
        several = F.col("records") > 1 if others is None else (F.col("records") > 0) & (F.col("others") > 0)
        a, b = (classes.select(*blocks, *[F.col(c).alias(f"{n}_{s}") for c, n in (("x", "x"), ("class_id", "class"), ("records", "records"), ("others", "others"))]) for s in "ab")
        inside = classes.where(several).select("class_id", F.lit(1.0).alias("similarity"), "records", "others")
        found = inside.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), "similarity", *[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("records", "others")])
        if r.kind == "fuzzy":
            near = similar_texts(classes.select(*blocks, "x"), blocks, r.threshold).join(a, [*blocks, "x_a"]).join(b, [*blocks, "x_b"])
            if others is not None:
                near = near.where("records_a > 0 AND others_b > 0 OR records_b > 0 AND others_a > 0")
            turned = F.col("class_a") > F.col("class_b")
            swap = {f"{n}_{s}": F.when(turned, F.col(f"{n}_{t}")).otherwise(F.col(f"{n}_{s}")) for n in ("class", "records", "others") for s, t in ("ab", "ba")}
            found = found.unionByName(near.select("similarity", *[c.alias(n) for n, c in swap.items()]))
        confidence = F.round(F.col("similarity") * r.weight, 3) if r.kind == "fuzzy" else F.lit(float(r.weight))
        found = found.select(F.lit(r.name).alias("rule"), "class_a", "class_b", confidence.alias("confidence"), *[f"{c}_{s}" for c in ("records", "others") for s in "ab"])
        members, pairs = (own, found) if members is None else (members.unionByName(own), pairs.unionByName(found))
    return Classes(members, pairs)


def in_factors(classes: Classes, sides: bool = False) -> DataFrame:
    """Pairs of classes, and each member as a row of its class with id (null in pairs) and, with ``sides``, its side: all matches in one table."""
    members = classes.members if sides else classes.members.drop("side")
    return classes.pairs.unionByName(members.withColumns({"class_a": F.col("class_id"), "class_b": F.col("class_id")}).drop("class_id"), allowMissingColumns=True)


def expanded(classes: Classes, rules: tuple[Rule, ...] = RULES, both: bool = False) -> DataFrame:
    """(id_a, id_b, rule, confidence): all pairs of rows that classes stand for, each by the first rule that matches it.

    Within one table id_a < id_b; with ``both``, a record and one of the others. As many rows as pairs: for small classes.
    """
    order = F.coalesce(*[F.when(F.col("rule") == r.name, i) for i, r in enumerate(rules)])
    a, b = (classes.members.select("rule", F.col("class_id").alias(f"class_{s}"), F.col("id").alias(f"id_{s}"), F.col("side").alias(f"side_{s}")) for s in "ab")
    turned = classes.pairs.where("class_a <> class_b").select("rule", F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "confidence")
    every = classes.pairs.select("rule", "class_a", "class_b", "confidence").unionByName(turned)
    hits = every.join(a, ["rule", "class_a"]).join(b, ["rule", "class_b"])
    hits = hits.where("side_a = 0 AND side_b = 1 AND id_a <> id_b" if both else "id_a < id_b")
    return hits.groupBy("id_a", "id_b").agg(F.min(F.struct(order.alias("order"), "rule", "confidence")).alias("m")).select("id_a", "id_b", "m.rule", "m.confidence")


def matches(df: DataFrame, others: DataFrame | None, blocks: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``match_classes``, expanded to pairs of rows."""
    return expanded(match_classes(df, others, blocks, rules), rules, others is not None)


def by_exact_keys(df: DataFrame, blocks: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Links of exact rules inside blocks without pairs: each row with the least id that shares its key. As many links as rows."""
    out = None
    for r in (r for r in rules if r.kind == "exact"):
        keys = [f"_k{i}" for i in range(len(r.fields))]
        keyed = df.where(_given(r)).select(*blocks, "id", *[_norm(f).alias(k) for f, k in zip(r.fields, keys, strict=True)])
        least = keyed.groupBy(*blocks, *keys).agg(F.min("id").alias("id_a"))
        links = keyed.join(least, [*blocks, *keys]).where("id_a < id").select("id_a", F.col("id").alias("id_b"))
        out = links if out is None else out.unionByName(links)
    return out


def by_fuzzy_text(df: DataFrame, blocks: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Links of fuzzy rules inside blocks: rows of one text with the least id of it, and the least ids of similar texts."""
    out = None
    for r in (r for r in rules if r.kind == "fuzzy"):
        rows = _texts(df, blocks, r)
        least = written(rows.dropna(subset=blocks).groupBy(*blocks, "x").agg(F.min("id").alias("id_a")), "least")
        same = rows.join(least, [*blocks, "x"]).where("id_a < id").select("id_a", F.col("id").alias("id_b"))
        near = similar_texts(least.select(*blocks, "x"), blocks, r.threshold)
        a, b = (least.select(*blocks, F.col("x").alias(f"x_{s}"), F.col("id_a").alias(f"id_{s}")) for s in "ab")
        links = same.unionByName(near.join(a, [*blocks, "x_a"]).join(b, [*blocks, "x_b"]).select("id_a", "id_b"))
        out = links if out is None else out.unionByName(links)
    return out


def link_components(df: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """df with group_id: the least id connected by links (id_a, id_b), its own without any.

    Large-star and small-star rounds: first every larger neighbour, then every smaller one, moves to the least of
    the neighbourhood. Minima combine in the map stage, so a hub costs a row for each task. An error after ``rounds``.
    """
    edges = written(links.select(F.greatest("id_a", "id_b").alias("hi"), F.least("id_a", "id_b").alias("lo")).where("hi <> lo").distinct(), "links")
    for _ in range(rounds):
        # done when every id has one edge, and those it leads to have none
        ends = edges.select(F.col("hi").alias("at"), F.lit(1).alias("up")).unionByName(edges.select(F.col("lo").alias("at"), F.lit(0).alias("up")))
        each = ends.groupBy("at").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        now = each.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up")))).alias("open")).first()
        if not now["open"]:
            break
        ends = edges.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionByName(edges.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
        least = ends.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("lo"))
        large = ends.where("to > at").join(least, "at").select(F.col("to").alias("hi"), "lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(least.select("hi", F.col("least").alias("lo")))
        before, edges = edges, written(small.where("hi <> lo").distinct(), "links", now["n"])
        discard(before)
    else:
        raise RuntimeError(f"links are still open after {rounds} rounds")
    roots = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("group_id"))
    return df.join(roots, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))


def link_candidates(df: DataFrame, candidates: DataFrame, blocks: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_a, id_b, rule, confidence): each record's hits among given candidates, by rules, inside blocks; not with itself."""
    return matches(df, candidates, blocks, rules)

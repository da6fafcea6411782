"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier decides.

Base spans are what the fixed patterns and their checks give; they always stay. Candidates are far
wider: whatever has an at (@, [at], (at)), every dotted or coloned group, every run of digits however
grouped, base matches that failed their check among them. Seven labelers vote on every candidate, base
ones too: the base pattern, the usual shape, the check (Luhn, ranges, digits), a gazetteer of endings
and beginnings, what stands next to it, words before it that speak for it, and words that speak against it.
Expectation-maximisation over the counted vote patterns estimates each labeler's reliability without any
labels; how seldom the check says no to a real one is known, though, and held fixed: a card number that fails its
check digit is none, however many such numbers there are. The posteriors train a naive Bayes classifier over the
candidates' shape, check and context, which decides on what isn't base.

All steps are DataFrame functions. Matches become rows, and a window over a text's rows sums the
lengths of what is before them; their number bounds the work. What reaches the driver are counts of
vote patterns and feature values, whose number the code below bounds.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Where a run of characters could be entered at any place of it, a match begins at the
# run's start or right behind the match before, and loops don't give back: the same matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried.
HINT = {"email": "instr(t, '@') > 0", "ip": r"t RLIKE '[0-9]\\.[0-9]'", "card": "t RLIKE '[0-9][ -]?[0-9]'", "phone": "instr(t, '+') > 0"}
VALID = {
    "email": "true",
    "ip": r"forall(split({m}, '\\.'), x -> length(ltrim('0', x)) <= 3 AND int(concat('0', ltrim('0', x))) <= 255)",
    "card": "length(translate({m}, ' -', '')) BETWEEN 14 AND 19 AND luhn_check(translate({m}, ' -', ''))",
    "phone": "length(translate({m}, '+ ().-', '')) BETWEEN 10 AND 15",
}
# Candidates: patterns with their hints. A run of digits is a card from 12 digits on, else a phone.
WIDER = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++\s?+(?:@|[\[({]\s?+at\s?+[\])}])\s?+[a-z0-9-]++(?:\s?+(?:\.|[\[({]\s?+dot\s?+[\])}])\s?+[a-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]++(?:\.[0-9]++){2,}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,}+)",
    "digits": r"(?:\+|\()?+[0-9](?:[ ._/()-]{0,2}+[0-9])++",
}
WIDER_HINT = {"email": r"t RLIKE '(?i)@|[\\[({]\\s?at\\s?[\\])}]'", "ip": r"t RLIKE '[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]'", "digits": "t RLIKE '[0-9]'"}
CARD_DIGITS = 12

# What the labelers go by: SQL over m (the match, lower-cased) and d (its digits).
SHAPE = {
    "email": r"m RLIKE '^[a-z0-9._%+-]++(@|\\s?[\\[({]\\s?at\\s?[\\])}]\\s?)[a-z0-9-]++' AND m RLIKE '[^a-z0-9-][a-z]{2,}$'",
    "ip": r"m RLIKE '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$|^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$|^[0-9a-f:]*::[0-9a-f:]*$'",
    "card": r"m RLIKE '^[0-9]{13,16}$|^[0-9]{4}([ ._/-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$|^[0-9]{4}([ ._/-])[0-9]{6}\\2[0-9]{5}$'",
    "phone": r"m RLIKE '^\\+[0-9][0-9 ().-]+$|^\\(?[0-9]{3}(\\) ?|[ ./-])[0-9]{3}[ ./-][0-9]{4}$'",
}
CHECK = {
    "email": r"m RLIKE '[@\\])}]\\s?[a-z0-9-]+\\s?(\\.|[\\[({])'",
    "ip": r"instr(m, ':') > 0 OR forall(split(m, '\\.'), x -> length(ltrim('0', x)) <= 3 AND int(concat('0', ltrim('0', x))) <= 255)",
    "card": "length(d) BETWEEN 13 AND 19 AND luhn_check(d)",
    "phone": "length(d) BETWEEN 10 AND 15",
}
# Gazetteers: top-level domains and countries' codes in use most, first octets of networks that aren't reserved, issuers' beginnings.
GAZETTEER = {
    "email": "m RLIKE '[^a-z](com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|us|uk|ca|au|nz|ie|de|at|ch|fr|be|nl|lu|es|pt|it|gr|pl|cz|sk|hu|ro|bg|se|no|dk|fi|is|ee|lv|lt|ru|ua|tr|il|in|cn|jp|kr|tw|hk|sg|th|vn|id|ph|my|za|ng|ke|eg|ma|br|mx|ar|cl|co|pe)$'",
    "ip": r"m RLIKE '^(?!10\\.|127\\.)([1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\\.|^(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cde][0-9a-f]{2}):'",
    "card": "d RLIKE '^(4|5[1-5]|2[2-7]|3[0-9]|50|5[6-9]|6|8|9)'",
    "phone": r"m RLIKE '^(\\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\\(?[2-9][0-9]{2}[) ./-])'",
}
FOR = {
    "email": "e-?mails?|contacts?|write|mail ?to|reply|adresse|courriel|correo|kontakt|contacto|schreiben|escriba|écrire",
    "ip": "ips?|hosts?|servers?|address|from|login|clients?|peer|remote|addr|adresse|serveur|servidor|dirección|anmeldung|connexion",
    "card": "cards?|visa|credit|debit|amex|mastercard|payments?|paid|billing|carte|karte|kreditkarte|tarjeta|paiement|zahlung|pago",
    "phone": "phones?|tel|telephone|call|fax|mobile|cell|dial|ring|sms|whatsapp|telefon|téléphone|teléfono|handy|portable|móvil|anrufen|appelez|llame",
}
AGAINST = "versions?|v|release|licen[sc]e|isbn|issn|doi|sections?|chapters?|figures?|tables?|pages?|invoice|orders?|ids?|nos?|numbers?|refs?|serial|builds?|tokens?|passwords?|secrets?|keys?|hash|sha|md5|kapitel|chapitre|página|seite|versión"
LABELERS = 7
#: Votes of a labeler on real personal data that are known beforehand: its number -> shares. A check is passed by what is real.
KNOWN = {2: {"+": 0.98, "-": 0.01, "0": 0.01}}


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body, in which name stands for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matches(number: int, pattern: str, hint: str) -> str:
    """SQL of array<struct<j, i, gap, m, before, after>>: all matches of a pattern in column t, with the length of what is before each."""
    quoted = _quoted(pattern)
    one = f"named_struct('j', {number}, 'i', i, 'gap', length(x.p[i]), 'm', m, 'before', lower(substring_index(x.p[i], ' ', -4)), 'after', left(x.p[i + 1], 1))"
    found = _bound(f"named_struct('p', split(t, {quoted}, -1), 'm', regexp_extract_all(t, {quoted}, 0))", "x", f"transform(x.m, (m, i) -> {one})")
    return f"CASE WHEN {hint} THEN {found} ELSE CAST(array() AS ARRAY<STRUCT<j: INT, i: INT, gap: INT, m: STRING, before: STRING, after: STRING>>) END"


def _by_kind(sql: dict[str, str]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {sql[k]}" for i, k in enumerate(KINDS)) + " END"


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every row, and the candidates (row, start, end, k, text, before, after, base), k the number of the kind.

    Texts are read once: what the patterns match is staged, and all that follows reads that. Candidates that
    touch a base span are left out.
    """
    patterns = [(BASE[k], HINT[k]) for k in KINDS] + [(WIDER[k], WIDER_HINT[k]) for k in WIDER]
    lists = ", ".join(_matches(j, p, h) for j, (p, h) in enumerate(patterns))
    texts = docs.select("doc_id", text_of().alias("t"))
    rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr(f"flatten(array({lists}))").alias("matches")), "matches")
    each = rows.where("size(matches) > 0").select("row", F.inline("matches")).repartition("row")
    upto = Window.partitionBy("row", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto).cast("int")
    spans = each.select("row", "j", "m", "before", "after", end.alias("end")).withColumns({"start": F.col("end") - F.length("m"), "base": F.col("j") < len(KINDS)})
    digits = F.length(F.regexp_replace("m", "[^0-9]", ""))
    run = F.when((digits < CARD_DIGITS) | F.startswith("m", F.lit("+")), KINDS.index("phone")).otherwise(KINDS.index("card"))
    kind = F.when(F.col("j") < len(KINDS) + 2, F.col("j") % len(KINDS)).otherwise(run)
    spans = spans.withColumn("k", kind.cast("int")).where("NOT base OR " + _by_kind({k: VALID[k].format(m="m") for k in KINDS}))
    before = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before), F.lit(0))
    right = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(behind), F.col("end"))
    spans = spans.withColumn("alone", F.col("base") | ((left <= F.col("start")) & (right >= F.col("end")))).where("alone")
    return rows.select("row", "doc_id"), staged(spans.select("row", "start", "end", "k", F.col("m").alias("text"), "before", "after", "base"), "spans")


def voted(spans: DataFrame) -> DataFrame:
    """spans with v, a string of LABELERS characters (+ for, - against, 0 no opinion), and f, an array of name=value."""
    s = spans.withColumns({"m": F.lower("text"), "d": F.regexp_replace("text", "[^0-9]", "")})
    said = _by_kind({k: f"before RLIKE '\\\\b({w})\\\\b'" for k, w in FOR.items()})
    against = f"before RLIKE '\\\\b({AGAINST})\\\\b'"
    beside = r"""(before RLIKE '[\\p{L}0-9"=_#/]$' OR after RLIKE '[\\p{L}0-9"_/]')"""
    signs = [f"IF({_by_kind(x)}, '+', '-')" for x in (SHAPE, CHECK, GAZETTEER)]
    votes = f"concat(IF(base, '+', '0'), {', '.join(signs)}, IF({beside}, '-', '+'), IF({said}, '+', '0'), IF({against}, '-', '0'))"
    separators = "concat_ws('', array_sort(array_distinct(split(regexp_replace(m, '[0-9a-z]', ''), ''))))"
    groups = "least(size(regexp_extract_all(m, '[0-9]+', 0)), 9)"
    side = r"CASE WHEN before = '' THEN 'none' WHEN before RLIKE '[0-9]$' THEN 'digit' WHEN before RLIKE '\\p{L}$' THEN 'letter' WHEN before RLIKE '\\s$' THEN 'space' ELSE 'mark' END"
    features = f"array(concat('digits=', least(length(d), 20)), concat('separators=', {separators}), concat('groups=', {groups}), concat('side=', {side}), concat('beside=', {beside}), concat('for=', {said}), concat('against=', {against}), concat('check=', {_by_kind(CHECK)}), concat('shape=', {_by_kind(SHAPE)}))"
    return s.withColumns({"v": F.expr(votes), "f": F.expr(features)}).drop("m", "d")


def reliabilities(counts: dict[str, float], rounds: int = 50) -> dict[str, float]:
    """P(personal | vote pattern), by expectation-maximisation of labelers' hit and false-alarm rates (with smoothing)."""
    if not counts:
        return {}
    prior = 0.5
    rates = [(KNOWN.get(i, {"+": 0.7, "-": 0.1, "0": 0.2}), {"+": 0.2, "-": 0.5, "0": 0.3}) for i in range(LABELERS)]
    post: dict[str, float] = {}
    for _ in range(rounds):
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(yes[c] / no[c]) for (yes, no), c in zip(rates, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (sum(n * post[v] for v, n in counts.items()) + 1) / (total + 2)))
        for i in range(LABELERS):
            yes, no = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
            for v, n in counts.items():
                yes[v[i]] += n * post[v]
                no[v[i]] += n * (1 - post[v])
            y, z = sum(yes[c] for c in "+-0"), sum(no[c] for c in "+-0")
            rates[i] = (KNOWN.get(i) or {c: yes[c] / y for c in "+-0"}, {c: no[c] / z for c in "+-0"})
    return post


def trained(spans: DataFrame) -> dict[str, float]:
    """Weights by kind|feature=value, and kind| for the intercept, from all documents' candidates, as voted() gives them.

    At most 4 kinds x 3**LABELERS vote patterns x the features' values (some hundreds) are counted.
    """
    rows = spans.select("k", "v", F.explode("f").alias("f")).groupBy("k", "v", "f").agg(F.count("*").alias("n")).collect()
    weights: dict[str, float] = {}
    for k in range(len(KINDS)):
        own = [(r["v"], r["f"], r["n"]) for r in rows if r["k"] == k]
        counts: dict[str, float] = defaultdict(float)
        for v, f, n in own:
            if f.startswith("side="):  # one of each span's features
                counts[v] += n
        post = reliabilities(counts)
        yes, no = sum(n * post[v] for v, n in counts.items()), sum(n * (1 - post[v]) for v, n in counts.items())
        weights[f"{k}|"] = math.log((yes + 1) / (no + 1))
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for v, f, n in own:
            sums[f][0] += n * post[v]
            sums[f][1] += n * (1 - post[v])
        for f, (a, b) in sums.items():
            weights[f"{k}|{f}"] = math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1))
    return weights


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (start, end, kind, text), positions in code points, end exclusive.

    Both are in order of start, then of kind. Added spans touch no base span. Null text is empty and holds nothing.
    Rows stay apart even if they repeat or have no doc_id; other columns are ignored, whatever their names; an empty
    table gives an empty table.
    """
    rows, spans = found(docs)
    spans = staged(voted(spans), "voted")
    weights = trained(spans)
    names = sorted(weights)
    table = f"map_from_arrays(array({', '.join(map(_quoted, names))}), array({', '.join(f'{weights[n]!r}D' for n in names)}))" if names else "map('', 0D)"
    score = f"aggregate(f, coalesce(element_at({table}, concat(k, '|')), 0D), (a, x) -> a + coalesce(element_at({table}, concat(k, '|', x)), 0D))"
    added = spans.where("NOT base").where(f"{score} > 0D")
    # of added spans that overlap the one of the first kind stays
    before = Window.partitionBy("row").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "k").rowsBetween(Window.unboundedPreceding, -1)
    free = F.lit(True)
    for k in range(1, len(KINDS)):
        end = F.coalesce(F.max(F.when(F.col("k") < k, F.col("end"))).over(before), F.lit(0))
        start = F.coalesce(F.min(F.when(F.col("k") < k, F.col("start"))).over(after), F.col("end"))
        free = free & ((F.col("k") != k) | ((end <= F.col("start")) & (start >= F.col("end"))))
    added = added.withColumn("free", free).where("free")
    both = spans.where("base").select("row", "start", "k", "end", "text", "base").unionByName(added.select("row", "start", "k", "end", "text", "base"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("base") == b, F.struct("start", "k", "end", "text")))).alias(n) for b, n in ((True, "b"), (False, "a"))]
    grouped = both.groupBy("row").agg(*lists)
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    named = "transform(coalesce({0}, array()), s -> named_struct('start', s.start, 'end', s.end, 'kind', {1}[s.k], 'text', s.text))"
    return rows.join(grouped, "row", "left").select("doc_id", F.expr(named.format("b", kinds)).alias("base"), F.expr(named.format("a", kinds)).alias("added"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans as text."""
    order = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

    def joined(spans: str) -> Column:
        keyed = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'o', array_position({order}, s.kind), 'end', s.end, 'kind', s.kind)))"
        return F.expr(f"array_join(transform({keyed}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS]
    return personal_data(docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, added)").alias("spans"))

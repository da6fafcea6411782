"""URL filters: rules first, else host words judged by naive Bayes.

Host labels and path segments are runs of letters, often several words in one. Unigram counts over
all page titles and the training names say how likely a word is, and the Viterbi path over a
run's substrings splits it. Substrings meet the unigram table in a join, so neither is held whole
by anyone. Multinomial naive Bayes judges the words. It is taught by the hosts whose pages a rule decides, all of
them, with the rules' own words left out, and by a list of labelled words. A host teaches a word once, however
many pages it has, and what a word says is what is sure of it: its log odds less some of their standard errors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, sized_broadcast, staged

#: (rule, verdict): a host suffix, then the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# Words of names that teach the judge beside the pages that rules decide: a default training set. Words that any host may have are in both classes.
_STRONG = "adult porn xxx sex sexy nude escort webcam casino poker betting bets slots jackpot lottery gambling pills viagra cialis pharma replica warez crack keygen torrent malware phishing spam scam payday ads adserver doubleclick tracker"
_WEAK = "hot cam dating bet gamble win free prize cheap discount pill loan hack x track click popup banner promo bonus deal offer farm"
_GOOD = "news wiki school university library science research museum health weather sport music book books art history city travel garden food recipe family photo forum docs help support article about contact archive code open project"
_COMMON = "www m blog shop home web index page html php en de fr es com net org example"
TRAINING = {"block": 4 * f"{_STRONG} " + f"{_WEAK} {_COMMON}", "allow": 4 * f"{_GOOD} " + _COMMON}
#: The share of names to block that is expected beforehand.
BLOCK_PRIOR = 0.2
#: What is added to a word's share of its list, so that one weak word alone does not block.
SMOOTHING = 2.5e-3
#: Hosts that must have a word for these to teach it, and the standard errors that its log odds are shrunk by.
LEAST_HOSTS, ERRORS = 5, 2.0


def parts_of(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host after the first ://, A-Z lower-cased; path to the first ? or #; empty without ://."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, begin = text.split("/", 1)
        fits = ((F.col(host) == of) | F.endswith(F.col(host), F.lit("." + of))) & F.startswith(F.col(path), F.lit("/" + begin))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def runs_of(text: Column) -> Column:
    """The runs of letters of a text, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def unigrams(pages: DataFrame, training: dict[str, str]) -> DataFrame:
    """(word, n) over all pages' titles, and the training words. Urls don't count: a joined name would be a word."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    counted = pages.select(F.explode(runs_of(title)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = staged(counted, "titles")
    # a training word counts for a hundredth of the titles' words, whatever their number; for ten if they are under a thousand
    n = max(10, (counted.agg(F.sum("n")).first()[0] or 0) // 100)
    own = pages.sparkSession.createDataFrame(sorted({(w, n) for v in training.values() for w in v.split()}), "word string, n long")
    return counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, found: list[tuple[int, int, float]], total: float) -> list[str]:
    """A run's words on the likeliest path, from its substrings (start, length, log probability) that are words.

    A stretch of letters in no word is as likely as a word of its length would be among ten per letter.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, length, p in found:
        ends.setdefault(start + length, []).append((start, p))
    letter = math.log(10)
    best = [(0.0, 0)]
    unknown = (0.0, 0)  # the best place for a stretch of unknown letters to begin, as if at the run's start
    for i in range(1, len(run) + 1):
        option = (unknown[0] - math.log(total) - i * letter, unknown[1])
        best.append(max([option, *((best[j][0] + p, j) for j, p in ends.get(i, ()))]))
        unknown = max(unknown, (best[i][0] + i * letter, i))
    words, i = [], len(run)
    while i:
        words.append(run[best[i][1] : i])
        i = best[i][1]
    return words[::-1]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for run, found, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append(viterbi(run, [(f["start"], f["length"], math.log(f["n"] / total)) for f in found or () if f is not None], total))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) for each distinct run of ``runs``; words: (word, n). Substrings are tried at the lengths that words have."""
    total = words.agg(F.sum("n")).first()[0] or 1
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect()) or [1]
    runs = runs.select("run").distinct()
    starts = F.explode(F.expr("sequence(1, length(run))")).alias("start")
    tried = F.explode(F.array(*map(F.lit, lengths))).alias("length")
    cut = runs.select("run", starts).select("run", "start", tried).where("start + length - 1 <= length(run)").withColumn("word", F.expr("substring(run, start, length)"))
    known = cut.join(words, "word").groupBy("run").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length", "n")).alias("found"))
    return mapped(runs.join(known, "run", "left").select("run", "found", F.lit(total).cast("double").alias("total")), _split, "run string, words array<string>")


def word_weights(told: DataFrame, hosts: dict[str, int], training: dict[str, str]) -> DataFrame:
    """(word, weight): log odds of block. told: (word, n_block, n_allow), how many decided hosts have a word; hosts: how many there are.

    The hosts' log odds, shrunk towards zero by ERRORS standard errors, and those of the list add up: a word that hosts of
    both classes have by chance, or that few have, weighs nothing.
    """
    taught = {k: v.split() for k, v in training.items()}
    rows = [(w, *(taught[k].count(w) / max(1, len(taught[k])) for k in ("block", "allow"))) for w in sorted({w for v in taught.values() for w in v})]
    both = told.join(told.sparkSession.createDataFrame(rows, "word string, l_block double, l_allow double"), "word", "full")
    yes, no = (F.coalesce(f"n_{k}", F.lit(0)) + 0.5 for k in ("block", "allow"))
    odds = F.log(yes / (hosts["block"] + 1)) - F.log(no / (hosts["allow"] + 1))
    sure = F.greatest(F.abs(odds) - ERRORS * F.sqrt(1 / yes + 1 / no), F.lit(0.0))
    seen = F.when(F.col("n_block") + F.col("n_allow") >= LEAST_HOSTS, F.signum(odds) * sure).otherwise(0.0)
    if not (hosts["block"] and hosts["allow"]):
        seen = F.lit(0.0)
    listed = F.log((F.coalesce("l_block", F.lit(0.0)) + SMOOTHING) / (F.coalesce("l_allow", F.lit(0.0)) + SMOOTHING))
    return both.select("word", (seen + listed).alias("weight"))


def judged(pages: DataFrame, rules=RULES, training: dict[str, str] = TRAINING) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, score) for every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the priors.
    score: log odds of block. Rows stay apart even if they repeat; other columns are ignored, whatever their names; an
    empty table gives an empty table.
    """
    host, path = parts_of()
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("h"), path.alias("p"))
    base = base.select("page_id", F.coalesce("h", F.lit("")).alias("host"), F.coalesce("p", F.lit("")).alias("path"))
    rule, verdict = ruled("host", "path", rules)
    keyed = base.withColumns({"hr": F.concat_ws(" ", runs_of(F.col("host"))), "pr": F.concat_ws(" ", runs_of(F.col("path"))), "rule": rule, "by_rule": verdict})
    # judged once for each set of runs: pages of a host differ in numbers mostly
    shapes = keyed.groupBy("hr", "pr").agg(*[F.count_if(F.col("by_rule") == k).alias(f"n_{k}") for k in ("block", "allow")])
    host_runs, path_runs = (F.array_remove(F.split(c, " "), "") for c in ("hr", "pr"))
    shapes = staged(shapes.select("hr", "pr", "n_block", "n_allow", F.concat(host_runs, path_runs).alias("all_runs"), F.size(host_runs).alias("hosts")), "shapes")
    runs = shapes.select(F.explode(F.array_distinct("all_runs")).alias("run"))
    words = staged(unigrams(pages, training), "unigrams")
    split = staged(segmented(runs, words), "segmented")
    # the judge: hosts of both classes by the words they have, the rules' own words left out
    own = sorted({w for text, _ in rules for w in re.findall(r"[^\W\d_]+", text.lower())})
    classes = [F.max((F.col(f"n_{k}") > 0).cast("int")).alias(f"n_{k}") for k in ("block", "allow")]
    sums = [F.sum(f"n_{k}").alias(f"n_{k}") for k in ("block", "allow")]
    decided = shapes.where("n_block + n_allow > 0")
    sizes = decided.groupBy("hr").agg(*classes).agg(*sums).first()
    hosts = {k: sizes[f"n_{k}"] or 0 for k in ("block", "allow")}
    taught = decided.select("hr", "n_block", "n_allow", F.explode("all_runs").alias("run")).groupBy("hr", "run").agg(*classes).join(split, "run")
    taught = taught.select("hr", "n_block", "n_allow", F.explode(F.array_distinct("words")).alias("word")).where(~F.col("word").isin(own) if own else F.lit(True))
    told = taught.groupBy("hr", "word").agg(*[F.max(f"n_{k}").alias(f"n_{k}") for k in ("block", "allow")]).groupBy("word").agg(*sums)
    weights = staged(word_weights(staged(told, "told"), hosts, training), "weights")
    prior = math.log(BLOCK_PRIOR / (1 - BLOCK_PRIOR))
    each = split.select("run", F.explode("words").alias("word")).join(sized_broadcast(weights), "word", "left").groupBy("run").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    each = split.join(each, "run", "left").select("run", "words", F.coalesce("w", F.lit(0.0)).alias("w"))
    at = shapes.select("hr", "pr", "hosts", F.posexplode_outer("all_runs").alias("at", "run"))
    scored = at.join(sized_broadcast(each), "run", "left").groupBy("hr", "pr").agg(
        (F.round(F.sum(F.coalesce("w", F.lit(0.0))), 9) + prior).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("at") < F.col("hosts"), F.struct("at", "words")))).alias("hw"),
    )
    scored = staged(scored.select("hr", "pr", "score", F.expr("flatten(transform(hw, x -> x.words))").alias("host_words")), "judged")
    return keyed.join(sized_broadcast(scored, 50_000), ["hr", "pr"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "host_words", "score"
    )

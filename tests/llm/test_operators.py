"""Text operators against plain versions on small tables, with nulls, empty, very long, tied and repeated rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scrubline.llm import byte_bpe, decontaminate, exact_dedup, html_text, integers, max_score, merkle, passages, pii, queries, simhash, token_counts, toxicity, url_filter, zone_maps
from scrubline.llm.common import components, parted, staged
from scrubline.llm.pretokens import cutter

SCHEMA = "doc_id long, text string, block long, n long, squeezed string, seed string, owner string, id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


CLASHES = "doc_id long, text string, kept string, keep_id string, group_size string, text_sha256 string, fingerprint string, component_id string, print long, score string"


def plain_stages(rows, toxic=()):
    """For each dropping stage, rows (doc_id, text) -> how often each (doc_id, text) must be there after it; None for the id stands last."""
    order = lambda r: (1 << 63 if r[0] is None else r[0])
    out = {"drop_toxic": collections.Counter(r for r in rows if not set((r[1] or "").split()) & set(toxic))}
    by = collections.defaultdict(list)
    for r in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "")].append(r)
    out["drop_copies"] = collections.Counter(min(g, key=lambda r: (-len(r[1] or ""), order(r))) for g in by.values())
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    out["drop_near_copies"] = collections.Counter(min((r for r, g in zip(rows, group, strict=True) if g == k), key=order)[0] for k in set(group))
    return out


def odd_rows():
    """Documents with every oddity: null and empty texts, a null id, a repeated row, ties, a very long text, odd characters."""
    rng = random.Random(7)
    body, long = words(rng, 120), words(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, body), (5, body + " "), (5, body + " "), (6, body.replace(" ", "\n", 3)), (7, long), (8, long), (None, body), (None, "alone"), (9, "x" * 50_000), (10, "é 😀 中文 \x00   end"), (11, "one two"), (12, "ONE two"), (13, body[: len(body) // 2] + " changed " + body[len(body) // 2 :]), (14, "1" * 30_000)]
    return [(i, t, 1, 2, "s", "s", "o", "i") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ------------------------------------------------------------------------------


def test_rice_codes_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 48, n))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values), len(values)) == values).all()
    assert len(exact_dedup.rice_encode(np.unique(rng.integers(0, 1 << 48, 10_000)))) < 10_000 * 5


def test_exact_groups(odd):
    got = exact_dedup.exact_groups(odd).collect()
    by = collections.defaultdict(list)
    for i, t, *_ in odd_rows():
        by[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), (1 << 63) if i is None else i))
    want = collections.Counter()
    for t, rows in by.items():
        keep = min(rows)[1]
        for k, (_, i) in enumerate(sorted(rows)):
            want[None if i == 1 << 63 else i, None if keep == 1 << 63 else keep, len(rows), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_colliding_fingerprints_are_told_apart(odd, spark):
    prints = staged(spark.range(100).selectExpr("xxhash64(id % 40) & 3 AS print"), "prints")
    assert exact_dedup.suspects(prints, bits=2).count() == 4
    prints = staged(spark.range(100).selectExpr("xxhash64(id % 60) & 4503599627370495 AS print"), "prints")
    assert exact_dedup.suspects(prints, owners=3, block_rows=7).count() == 40


def test_more_suspects_than_are_broadcast(odd):
    def rows(df):
        return collections.Counter(map(str, df.collect()))

    assert rows(exact_dedup.exact_groups(odd, 1).select("doc_id", "group_size", "text_sha256")) == rows(exact_dedup.exact_groups(odd).select("doc_id", "group_size", "text_sha256"))
    assert rows(exact_dedup.drop_copies(odd, 1).select("text")) == rows(exact_dedup.drop_copies(odd).select("text"))
    assert simhash.drop_near_copies(odd, 1).count() == simhash.drop_near_copies(odd).count()


def test_filter_by_keys_holds_all_of_them(spark):
    keys = staged(spark.range(0, 5000, 5).select(F.xxhash64("id").alias("k")), "keys")
    df = spark.range(5000).select("id", F.xxhash64("id").alias("k"))
    some, rest = parted(df, "k", keys, limit=10)
    ids = {r.id for r in some.collect()}
    assert ids >= set(range(0, 5000, 5)) and len(ids) < 1200 and ids.isdisjoint(r.id for r in rest.collect()) and rest.count() == 5000 - len(ids)


# --- simhash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(odd):
    got = simhash.near_groups(odd).collect()
    prints = collections.defaultdict(list)
    for i, t, *_ in odd_rows():
        prints[plain_fingerprint(t)].append((1 << 63) if i is None else i)
    group = {p: p for p in prints}
    for _ in prints:
        for p in prints:
            for q in prints:
                if (p ^ q).bit_count() <= 2:
                    group[p] = group[q] = min(group[p], group[q])
    least = {g: min(i for p in prints if group[p] == g for i in prints[p]) for g in group.values()}
    want = collections.Counter((None if i == 1 << 63 else i, f"{p:016x}", None if least[group[p]] == 1 << 63 else least[group[p]]) for p in prints for i in prints[p])
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_busy_segments_find_the_same_links(spark):
    rng = random.Random(3)
    values = {0, -1} | {rng.getrandbits(63) for _ in range(200)}
    values |= {v ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for v in list(values) for _ in range(3)}
    values |= {(7 << 32) | rng.getrandbits(12) for _ in range(300)}
    df = spark.createDataFrame([(v,) for v in values], "print long")
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 2}
    for busy in (2, 10_000):
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df, busy).collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(51), 100, 200, 300, 400]], "node long")
    got = {r.node: r.root for r in components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 200: 100, 300: 100, 400: 400}


# --- decontamination --------------------------------------------------------------------------


def test_contaminated(spark, odd, empty):
    rng = random.Random(5)
    item = words(rng, 40)
    cut = item.split()
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "Two, WORDS", "x"), (4, "", "x"), (5, words(rng, 60), "x"), (None, "lonely pair here", "x")], "item_id long, text string, n string")
    far = words(rng, 3000)
    docs = [(1, far + " " + item.upper() + "! " + far), (2, " ".join(cut[:38])), (3, " ".join(cut[:20])), (4, "two words"), (5, None), (6, ""), (7, far), (None, item), (8, "a lonely pair, here"), (8, "a lonely pair, here")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int"), items).collect()}
    assert got == {(1, 1), (2, 1), (4, 3), (None, 1), (8, None)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()} == {3, 5, 6, 7}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, items).count() == 0


def test_stages_keep_just_the_right_rows(spark, toxic_world):
    _, taught, labels = toxic_world
    rng = random.Random(41)
    bad, item = "a nitwit and a nitwit", words(rng, 40)
    rows = [r[:2] for r in odd_rows()] + [(None, bad), (None, "quite alone here"), (5, "another text of five"), (5, bad), (20, "clean row"), (None, item), (None, "other clean row"), (21, "x " + item), (21, "of the same id"), (22, item[:100]), (None, " ".join(item.split()[:14])), (None, " ".join(item.split()[13:27]))]
    docs = spark.createDataFrame([(*r, "k", "i", "g", "s", "f", "c", 1, "o") for r in rows], CLASHES).repartition(3)
    want = plain_stages(rows, {"nitwit"})
    both = taught.select("doc_id", "text", *[F.lit(None).alias(c) for c in docs.columns[2:]])
    told = toxicity.drop_toxic(docs.unionByName(both.withColumn("doc_id", F.col("doc_id") + 1000)), labels.withColumn("doc_id", F.col("doc_id") + 1000)).where("kept IS NOT NULL")
    got = {"drop_toxic": told, "drop_copies": exact_dedup.drop_copies(docs), "drop_near_copies": simhash.drop_near_copies(docs)}
    for name, df in got.items():
        assert df.columns == docs.columns
        found = df.collect()
        assert all(tuple(r)[2:] == ("k", "i", "g", "s", "f", "c", 1, "o") for r in found)
        assert collections.Counter(r.doc_id if name == "drop_near_copies" else (r.doc_id, r.text) for r in found) == want[name], name
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = collections.Counter((r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, items).collect())
    assert clean == collections.Counter(r for r in rows if item not in (r[1] or ""))
    assert collections.Counter(r.doc_id for r in decontaminate.contaminated(docs, items).collect()) == {None: 1, 21: 1}


# --- tokens -----------------------------------------------------------------------------------

PIECES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "a", "the", "Word", "é", "ß", "ª", "1", "42", "²", "¼", "Ⅷ", "中文", "😀", "'s", "'LL", ".", "!!", "<|endoftext|>", "​", "\x00", "ि"]


def texts():
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["a" * 3000, "=" * 700 + " " * 300 + "x", "zq" * 400]


def encoding(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(name)), special_tokens={})


def test_cutter_equals_the_pattern():
    import regex

    cut, whole = cutter(P.PATTERN), regex.compile(P.PATTERN)
    assert all(cut(t) == whole.findall(t) for t in texts())


def test_encoding_equals_the_library(spark):
    own, want = encoding("byte_bpe_multi_50k.tiktoken"), texts()
    docs = spark.createDataFrame([*enumerate(want), (-1, None), (-1, None)], "doc_id long, text string")
    got = byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(want) + 2
    for r in got:
        text = want[r.doc_id] if r.doc_id >= 0 else ""
        assert (list(r.ids), r.decoded) == (own.encode_ordinary(text), text)
    r = byte_bpe.digests(docs.where("doc_id = 5"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first()
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ordinary(want[5]))).encode()).hexdigest()


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path, want = P.path("byte_bpe_50k.json"), texts()
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame([*enumerate(want), (-1, None)], "doc_id long, text string"), path).collect()}
    assert (got[-1].n_bytes, got[-1].n_tokens, got[-1].over_limit) == (0, 0, False)
    for i, t in enumerate(want):
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(spark, name):
    counting = token_counts.Counting(P.path(name))
    docs = spark.createDataFrame([(1, "some plain  text"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path(name)).collect()} == {1: counting.lengths_of(["some plain  text"])[0], 2: counting.lengths_of([""])[0]}


# --- toxicity ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_world(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, rng.randint(5, 60)).split()
        bad = i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "dunce"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(toxic_world):
    rows, docs, labels = toxic_world
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)


def test_evidence_is_the_plain_sum():
    score = toxicity.Scorer(np.zeros((toxicity.SYMBOLS,) * 3, np.float32), {"idiot$": 5.0, "nice$": -2.0, "stup": 4.0, "weak$": 2.0})
    assert score.evidence("An idiot stupid stupid nice word") == (5.0, (5.0 + 4.0 - 2.0) / math.sqrt(5))
    assert score.evidence("weak word") == (0.0, 2.0 / math.sqrt(2)) and score.evidence(" ") == (0.0, 0.0)


def test_weights_equal_plain_ones(toxic_world):
    rows, docs, labels = toxic_world
    model, weights, _ = toxicity.fitted(docs, labels)
    fix = toxicity.Restorer(model)
    train = {t: int(i % 6 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    ill, fine = sum(train.values()), len(train) - sum(train.values())
    counts = collections.defaultdict(lambda: [0, 0])
    for t, y in train.items():
        for f in {f for p in set(t.split()) for w in toxicity.words_of(fix.piece(p)) for f in toxicity.features(w)}:
            counts[f][1 - y] += 1
    want = {}
    for f, (t, n) in counts.items():
        seen, share = t + n, ill / (ill + fine)
        ratio = 2 * sum(c * math.log(c / (seen * s)) for c, s in ((t, share), (n, 1 - share)) if c)
        odds = math.log((t + 0.5) / (ill + 1)) - math.log((n + 0.5) / (fine + 1))
        w = math.copysign(max(0.0, abs(odds) - 2 * math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))), odds)
        if w and ratio >= 2 * math.log(len(counts)) + toxicity.MARGIN:
            want[f] = w
    assert want.keys() == weights.keys() and all(abs(want[f] - weights[f]) < 1e-9 for f in want)


def test_hidden_words_are_restored(toxic_world):
    _, docs, labels = toxic_world
    fix = toxicity.Restorer(toxicity.character_model(docs))
    assert fix.text("a bl0ckhe4d here") == "a blockhead here"
    assert fix.text("n i t w i t") == "nitwit"
    assert fix.text("n.i.t.w.i.t, duuunce") == "nitwit, dunce"
    assert fix.text("plain words, 1234 and 5!") == "plain words, 1234 and 5!"


def test_toxicity_of_odd_rows(spark, odd, empty, toxic_world):
    _, docs, labels = toxic_world
    assert toxicity.toxicity(empty, labels).count() == 0
    got = toxicity.toxicity(odd, labels.withColumn("toxic", F.lit(None).cast("int"))).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


# --- personal data ----------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for o, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            out += [(m.start(), o, m.end(), kind)] * ok
    return sorted(out)


def test_base_spans(spark, empty):
    rng = random.Random(17)
    parts = ["a@b.c", "@", "x.", "1.2.3.4", ".", "4", " ", "-", "+1 (555) 555-0100", "256.1.1.1", "4111 1111 1111 1111", "+", "(", "é", "😀", "00", "_", "\n", "john [at] example [dot] com", "555-123-4567", "0001.02.3.255"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)] + [(2000, None), (2000, None), (2001, "1.1.1" * 600)]
    got = pii.digests(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()
    texts_ = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = plain_spans(texts_[r.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
    assert pii.digests(empty).count() == 0


def test_very_long_runs_are_linear(spark):
    rows = [(1, "1" * 300_000), (2, "a" * 300_000 + "@x"), (3, "+1" + ". " * 100_000), (4, "1 " * 100_000), (5, "a@" + "b." * 100_000)]
    assert pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_reliabilities_tell_good_labelers():
    post = pii.reliabilities({"+++0000": 90.0, "++++000": 40.0, "0--0000": 80.0, "0-+0-00": 20.0})
    assert post["+++0000"] > 0.9 and post["0--0000"] < 0.1


def test_added_spans(spark):
    """Numbers of a card's form without its check are added, short numbers, versions and parts of longer words aren't; base spans stay apart."""
    rng = random.Random(19)
    rows, want = [], {}
    for i in range(400):
        w = words(rng, 12).split()
        number, kind = "".join(rng.choice("123456789") for _ in range(16)), i % 5
        hidden = {0: number, 1: f"bob{i} [at] mail [dot] com", 2: f"version {i % 7}.{i % 5}", 3: f'token = "a{number}b"', 4: f"mail a{i}@b.org"}[kind]
        text = " ".join([*w[:6], hidden, *w[6:]])
        rows.append((i, text))
        base = plain_spans(text)
        start = text.index(hidden)
        want[i] = [] if kind in (2, 3) or base else [(start, start + len(hidden))]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")).collect()}
    assert sum([(x.start, x.end) for x in got[i].added] == want[i] for i in want) >= 0.98 * len(want)
    for i, text in rows:
        assert [(x.start, x.end, x.kind) for x in got[i].base] == [(a, b, k) for a, _, b, k in plain_spans(text)]
        assert all(text[x.start : x.end] == x.text for x in [*got[i].base, *got[i].added])
        assert not any(b.start < a.end and a.start < b.end for a in got[i].added for b in got[i].base)


def plain_reliabilities(rows, rounds=200):
    """Expectation-maximisation over single spans instead of counted patterns."""
    post, n = [0.5] * len(rows), len(rows)
    prior, rates = 0.5, [(pii.KNOWN.get(i, {"+": 0.7, "-": 0.1, "0": 0.2}), {"+": 0.2, "-": 0.5, "0": 0.3}) for i in range(len(rows[0]))]
    for _ in range(rounds):
        for j, v in enumerate(rows):
            yes, no = prior, 1 - prior
            for (a, b), c in zip(rates, v, strict=True):
                yes, no = yes * a[c], no * b[c]
            post[j] = yes / (yes + no)
        prior = (sum(post) + 1) / (n + 2)
        for i in range(len(rows[0])):
            each = [{c: 1 + sum(w for w, v in zip(ws, rows, strict=True) if v[i] == c) for c in "+-0"} for ws in (post, [1 - p for p in post])]
            each[0] = pii.KNOWN.get(i, each[0])
            rates[i] = tuple({c: x / sum(e.values()) for c, x in e.items()} for e in each)
    return dict(zip(rows, post, strict=True))


def test_reliabilities_equal_plain_ones():
    rng = random.Random(5)
    rows = ["".join(rng.choices("+-0", weights=(6, 1, 3) if k % 3 else (1, 6, 3))[0] for _ in range(pii.LABELERS)) for k in range(120)]
    plain = plain_reliabilities(rows)
    for v, p in pii.reliabilities(collections.Counter(rows), rounds=200).items():
        assert abs(p - plain[v]) < 0.01


def luhn(digits):
    """The digits with the check digit behind them."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return digits + str(-total % 10)


@pytest.mark.parametrize("size", [60, 600])
def test_planted_spans_are_added_and_decoys_are_not(spark, size):
    """Written-out e-mails, grouped phones and cards with odd separators among base ones, and numbers that are nothing of the kind."""
    rng = random.Random(size)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(6))
    four = lambda d, by: by.join(d[i : i + 4] for i in range(0, 16, 4))
    base = [lambda: f"mail me at {name()}@{name()}.com please", lambda: f"call +{rng.choice('1347')} {digits(3)} {digits(3)} {digits(4)} now", lambda: f"paid by card {luhn('4' + digits(14))} today", lambda: f"server {rng.randrange(11, 200)}.{rng.randrange(256)}.{rng.randrange(256)}.9 is up"]
    real = [lambda: ("write to ", f"{name()} [at] {name()} [dot] org", " soon"), lambda: ("phone ", f"(416) 555-0{digits(3)}", " or write"), lambda: ("card ", four(luhn("4" + digits(14)), "."), " was charged"), lambda: ("contact ", f"{name()}(at){name()}.net", " for more")]
    decoys = [lambda: ("order ", digits(16), " was sent"), lambda: ("version ", ".".join(digits(2) for _ in range(5)), " is out"), lambda: ("id ", digits(13), " in the list"), lambda: ("it took ", digits(3), " days"), lambda: ("from ", f"19{digits(2)} to 20{digits(2)}", " it stood"), lambda: ("serial ", four(digits(16), "/"), " of the set")]
    rows, want = [], set()
    for i in range(size):
        text = " ".join(words(rng, 6) for _ in range(2))
        parts = [("base", rng.choice(base)())]
        parts.append(("real", rng.choice(real)()))
        parts += [("decoy", d()) for d in rng.sample(decoys, 3)]
        rng.shuffle(parts)
        for kind, said in parts:
            text += " . "
            if kind == "base":
                text += said
                continue
            if kind == "real":
                want.add((i, len(text + said[0]), len(text + said[0] + said[1])))
            text += "".join(said)
        rows.append((i, text))
    got = {(r.doc_id, a.start, a.end) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for a in r.added}
    assert len(got & want) >= 0.9 * len(got) and len(got & want) >= 0.9 * len(want)


# --- urls and pages ---------------------------------------------------------------------------


def test_url_verdicts(spark):
    urls = ["http://A.example.ORG/es/1?x", "https://example.org/en/123", "http://x.com/fr/a#b", "http://x.com/de/", "http://onlinecasinopoker.net/win", "http://museumlibrary.net/art", "no scheme", None, "http://x.org", "http://notexample.org/es/", "://h/p", "http://H?q"]
    pages = spark.createDataFrame([(i, u, "<title>the museum library online</title>", "r") for i, u in enumerate(urls)] + [(0, urls[0], None, "r")], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    told = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert told[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert told[1] == ("example.org", "/en/123", "example.org/en/1", "block")
    assert told[2] == ("x.com", "/fr/a", "com/fr/", "allow") and told[3] == ("x.com", "/de/", "com/de/", "block")
    assert told[4][2:] == (None, "block") and told[5][2:] == (None, "allow")
    assert told[6][:3] == told[7][:3] == ("", "", None)
    assert told[8] == ("x.org", "", None, "allow") and told[9][2:] == ("org/", "allow")
    assert told[10][:2] == ("h", "/p") and told[11][:2] == ("h", "")
    assert got[4].host_words[:3] == ["online", "casino", "poker"]
    assert url_filter.judged(pages.limit(0)).count() == 0
    assert url_filter.judged(pages).count() == len(urls) + 1


def test_words_and_verdicts_do_not_change_with_size(spark):
    hosts = {"freebetwin": ["free", "bet", "win"], "hotfreewin": ["hot", "free", "win"], "sexadsbet": ["sex", "ads", "bet"], "freepornxxx": ["free", "porn", "xxx"], "museumlibrary": ["museum", "library"]}
    urls = spark.createDataFrame([(i, f"http://{h}.net/", None) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    for size in (1, 100, 20_000):  # up to 4.6 million words of titles
        titles = spark.range(min(size, 400)).select((F.col("id") + 100).alias("page_id"), F.lit("http://x.org/").alias("url"), F.concat(F.lit("<title>"), F.repeat(F.lit(" ".join(["the of be t w in to and a on for weather"] * 19 + ["rare win free"]) + " "), F.lit(max(1, size // 400))), F.lit("</title>")).alias("html"))
        got = {r.page_id: r for r in url_filter.judged(urls.unionByName(titles)).where("page_id < 100").collect()}
        assert [got[i].host_words[:-1] for i in range(len(hosts))] == list(hosts.values()), size
        assert [got[i].verdict for i in range(len(hosts))] == ["block"] * 4 + ["allow"], size


def test_viterbi_is_the_best_of_all_splits():
    rng = random.Random(3)
    for _ in range(200):
        run = "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))
        vocabulary = {w: rng.random() for w in ("a", "b", "ab", "ba", "aab", "bab", "abba") if rng.random() < 0.6}
        total = sum(vocabulary.values()) * 3 + 1
        log = lambda w: math.log(vocabulary[w] / total) if w in vocabulary else -math.log(total) - len(w) * math.log(10)
        splits = [[run[i:j] for i, j in zip([0, *cut], [*cut, len(run)], strict=True)] for n in range(len(run)) for cut in itertools.combinations(range(1, len(run)), n)]
        # a word may also be taken for a stretch of unknown letters
        value = lambda ws: sum(max(log(w), -math.log(total) - len(w) * math.log(10)) for w in ws)
        found = [(i, len(w), math.log(p / total)) for w, p in vocabulary.items() for i in range(len(run)) if run.startswith(w, i)]
        got = url_filter.viterbi(run, found, total)
        assert "".join(got) == run and abs(value(got) - max(map(value, splits))) < 1e-9


def test_hosts_that_rules_decide_teach_the_judge(spark):
    """Scores equal shrunk log odds worked out plainly, each word once a host, however many pages it has."""
    names = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    rng = random.Random(8)
    hosts = [(f"{rng.choice(names[:4])}{'x' * rng.randrange(30)}q.{rng.choice(names[:4])}.com", "/de/") for _ in range(90)] + [(f"{rng.choice(names[2:])}{'x' * rng.randrange(30)}q.{rng.choice(names[2:])}.org", "/") for _ in range(90)]
    urls = [f"http://{h}{p}{i}" for h, p in hosts for i in range(1 + 20 * (h[0] == "a"))] + [f"http://{a}.net/{b}" for a in names for b in names]
    pages = spark.createDataFrame([(i, u, f"<title>{' '.join([*names, *('x' * k + 'q' for k in range(30))])}</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {urls[r.page_id]: r for r in url_filter.judged(pages).collect()}
    told = {k: {h: set(re.findall("amber|birch|cedar|delta|ember|fjord", h)) for h, p in hosts if p == q} for k, q in (("block", "/de/"), ("allow", "/"))}

    def weight(w):
        yes, no = (sum(w in ws for ws in told[k].values()) for k in ("block", "allow"))
        odds = math.log((yes + 0.5) / (len(told["block"]) + 1)) - math.log((no + 0.5) / (len(told["allow"]) + 1))
        return 0.0 if yes + no < url_filter.LEAST_HOSTS else math.copysign(max(0.0, abs(odds) - url_filter.ERRORS * math.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))), odds)

    common = math.log((1 / len(url_filter.TRAINING["block"].split()) + url_filter.SMOOTHING) / (1 / len(url_filter.TRAINING["allow"].split()) + url_filter.SMOOTHING))
    for a in names:
        for b in names:
            assert abs(got[f"http://{a}.net/{b}"].score - (math.log(0.25) + common + weight(a) + weight(b))) < 1e-6
    assert weight("amber") > 0 > weight("fjord")


@pytest.mark.parametrize("size", [60, 1500])
def test_planted_hosts_are_told_apart(spark, size):
    """Hosts of listed words, of a word that only blocked hosts have, and of random names and fragments, at two sizes."""
    rng = random.Random(71)
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "ion")]
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    good, bad = url_filter._GOOD.split(), url_filter._STRONG.split()
    rows, want = [], {}

    def page(url):
        rows.append((len(rows), url, f"<title>{' '.join([name(), 'tion', 'er', *rng.sample(good, 3), rng.choice(bad), 'zorbix'])}</title>"))
        return len(rows) - 1

    for _ in range(size):  # decided by rules: random names, some hosts with many pages, and a word of the blocked ones
        for url in (f"http://{name()}{rng.choice(['zorbix', '', ''])}.com/de/x", f"http://{name()}.org/x"):
            for _ in range(rng.choice((1, 1, 1, 12))):
                page(url)
    for _ in range(size):
        want[page(f"http://{name()}.net/{name()}")] = "allow"
        want[page(f"http://{rng.choice(good)}{name()}.example.com/{rng.choice(good)}")] = "allow"
        want[page(f"http://{rng.choice(bad)}{rng.choice(bad)}.net/")] = "block"
        if size > 100:
            want[page(f"http://{name()}zorbix.net/")] = "block"
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hits = sum(got[i] == v == "block" for i, v in want.items())
    assert hits / sum(got[i] == "block" for i in want) >= 0.95 and hits / sum(v == "block" for v in want.values()) >= 0.95


ARTICLE = "<h1>T &amp; x</h1><p>a&nbsp;b  <b>c</b>\n d<p>e<ul><li>f<li>g</ul>"


def test_html(spark):
    page = f'<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>m</nav><div class="cookie-notice">We use cookies</div><main><article>{ARTICLE}<form>s<input></form><aside>q</aside><script>if(a<b)"</p>"</script><!-- c --><div class="comments"><p>nope</p></div></article></main><footer>z</footer></body></html>'
    rows = [(1, "http://h/1", page), (2, "http://h/2", page.replace("T &amp; x", "Other")), (3, "http://k/1", "just text"), (4, None, None), (5, "http://h/3", ""), (6, "http://h/4", "<p>unclosed <b>bold<br><p>next &lt;tag&gt; &#233;"), (6, "http://h/4", "<p>unclosed <b>bold<br><p>next &lt;tag&gt; &#233;"), (7, "http://l/1", "<article>" + "<p>x</p>" * 20_000 + "</article>")]
    got = html_text.extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()
    told = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert told[1] == "T & x\na b c d\ne\nf\ng" and told[2] == "Other\na b c d\ne\nf\ng"
    assert (told[3], told[4], told[5]) == ("just text", "", "") and told[6] == "unclosed bold\nnext <tag> é"
    assert told[7] == "\n".join("x" * 20_000) and all(r.n_chars == len(r.text) for r in got)


def site(host, n):
    """Pages of one host with a repeated line inside the article, a plain menu, and an advert that differs from page to page."""
    rng = random.Random(host)
    out = []
    for i in range(n):
        body = [words(rng, 12), "Read our weekly letter for more", words(rng, 9), f"Filed under {i % 2}"]
        page = f"<body><div><p>Front page of {host}</p><p>All other news</p></div><div class=ad>{words(rng, 5)}</div><article><header><h1>{body[0]}</h1></header>" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"<div class='search related'>kept {i}</div></article></body>"
        out.append((1000 * hash_of(host) + i, f"http://{host}/{i}", page, "\n".join([body[0], body[2], body[3], f"kept {i}"]), "\n".join([*body, f"kept {i}"])))
    return out


def hash_of(text):
    return sum(map(ord, text))


def test_templates_take_what_repeats(spark):
    rows = site("a.org", 9) + site("bb.org", 5) + site("few.org", 4)
    pages = spark.createDataFrame([(i, u, h) for i, u, h, _, _ in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    plain = {r.page_id: r.text for r in html_text.extracted(pages, use_templates=False).collect()}
    for i, url, _, want, whole in rows:
        assert got[i] == (whole if "few.org" in url else want) and plain[i] == whole


def test_templates_equal_plain_classes(spark):
    rows = site("a.org", 9) + site("bb.org", 5)
    rows = [(i, u, h.replace("<p>All", "<p>x<p>All") if i % 7 == 0 else h) for i, u, h, *_ in rows]
    pages = spark.createDataFrame(rows, "key long, url string, html string").withColumn("host", url_filter.parts_of()[0])
    got = {r.host: sorted(r.template) for r in html_text.templates(pages).collect()}
    for host in ("a.org", "bb.org"):
        of = [dict((t, (n, z)) for t, n, z in html_text.Page(h).tokens()) for _, u, h in rows if host in u]
        classes = collections.defaultdict(list)
        for t in set().union(*of):
            if sum(t in p for p in of) >= html_text.SUPPORT * len(of):
                classes[tuple(p.get(t, (0, 0))[0] for p in of)].append(t)
        size = lambda ts: sum(max(p[t][1] for p in of if t in p) for t in ts)
        assert got[host] == sorted(t for ts in classes.values() if size(ts) >= 3 for t in ts)


def extracted(spark, pages):
    return [r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).sort("page_id").collect()]


def test_copies_of_an_article_are_no_template(spark):
    """Hosts that repeat one article, word by word, but for a word, or with one page held many times, keep it whole."""
    rng = random.Random(61)
    title, first, second = words(rng, 5), words(rng, 40), words(rng, 30)
    page = lambda t, a, b: f"<body><p>Front page of all the news</p><article><h1>{t}</h1><p>{a}</p><p>{b}</p></article></body>"
    equal = [(i, f"http://eq.org/{i}", page(title, first, second)) for i in range(6)] + [(6, "http://eq.org/6", page(title, first + " more", second))]
    near = [(10 + i, f"http://near.org/{i}", page(title, first, f"{second} x{i}")) for i in range(8)]
    whole = "\n".join([title, first, second])
    assert extracted(spark, equal) == [whole] * 6 + ["\n".join([title, first + " more", second])]
    assert extracted(spark, near) == [f"{whole} x{i}" for i in range(8)]
    bare = [(20 + i, f"http://bare.org/{i}", f"<body><p>{first}</p></body>") for i in range(6)]
    assert extracted(spark, bare) == [first] * 6
    rows = site("a.org", 9)
    held = [(i, u, h) for i, u, h, *_ in rows for _ in range(1 + 3 * (i == rows[0][0]))]
    assert sorted(set(extracted(spark, held))) == sorted(r[3] for r in rows) and len(held) == 12


def test_templates_find_the_slots_of_pages_without_an_article(spark):
    rng = random.Random(67)
    bodies = [[words(rng, 15), words(rng, 25)] for _ in range(12)]
    shell = "<body><div class=top><p>Harbour Weekly</p><p>Town and coast since 1921</p></div><div class=text>{}</div><div class=low><p>Printed on the quay by hand</p></div></body>"
    pages = [(i, f"http://slots.org/{i}", shell.format("".join(f"<p>{b}</p>" for b in body))) for i, body in enumerate(bodies)]
    assert extracted(spark, pages) == ["\n".join(b) for b in bodies]
    few = extracted(spark, pages[: html_text.LEAST_PAGES - 1])
    assert all("Harbour Weekly" in t for t in few)


def test_pages_are_read_in_linear_time():
    for source in ("<a " * 350_000, "<b>" * 100_000 + "<p>x</p>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, '<a title="x' * 100_000):
        start = time.time()
        html_text.Page(source).text()
        assert time.time() - start < 20
    assert html_text.Page("1 < 2 <b>and</b> x <y").text() == "1 < 2 and x <y"


# --- passages ---------------------------------------------------------------------------------


def test_repeated_passages(spark, empty):
    rng = random.Random(23)
    passage = words(rng, 70)
    fuzzy = passage.split()
    for i in range(8, 70, 12):
        fuzzy[i] = "changed"
    docs = [(i, words(rng, 80) + " " + (passage if i % 2 else " ".join(fuzzy)) + " " + words(rng, 30)) for i in range(12)] + [(100 + i, words(rng, 200)) for i in range(6)] + [(200, None), (201, ""), (202, "short"), (203, "x " * 5000)]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, seed string")).collect()}
    assert set(got) == set(range(12)) and {r.class_id for r in got.values()} == {0}
    for r in got.values():
        start, end = map(int, r.spans.split(",")[0].split(":"))
        assert abs(start - 80) <= 12 and abs(end - 150) <= 12
    assert passages.repeated(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_passages_whose_parts_have_other_first_holders(spark, parts):
    rng = random.Random(29)
    one, two, three = (words(rng, 30) for _ in "abc")
    holds = {1: one, 2: two, 3: three, 10: f"{one} {two}", 11: one, 12: two, 13: f"{one} {two}", 20: f"{two} {three}", 21: f"{two} {three}"}
    docs = spark.createDataFrame([(i, f"{words(rng, 50)} {t} {words(rng, 50)}") for i, t in holds.items()], "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.class_id, [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]) for r in passages.repeated(docs).collect()}
    assert {i: c for i, (c, _) in got.items()} == {10: 10, 13: 10, 20: 20, 21: 20}
    assert all(spans == [(50, 110)] for _, spans in got.values())


def test_every_shared_run_of_the_least_length_is_found(spark):
    rng = random.Random(31)
    rows = []
    for g in range(40):  # runs of just MIN_WORDS words, and one word less; their halves are first in other documents
        size = passages.MIN_WORDS - (g % 4 == 3)
        run = words(rng, size).split()
        held = [run[: size // 2], run[size // 2 :], run, run]
        rows += [(10 * g + i, f"{words(rng, 30)} {' '.join(h)} {words(rng, 30)}") for i, h in enumerate(held)]
    got = {r.doc_id: r.class_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * g + i: 10 * g + 2 for g in range(40) if g % 4 != 3 for i in (2, 3)}


def test_a_fuzzy_passage_whose_sentences_are_first_elsewhere(spark):
    rng = random.Random(37)
    sentences = [words(rng, 28) for _ in "abc"]
    passage = lambda: f"{sentences[0]} {words(rng, 4)} {sentences[1]} {words(rng, 4)} {sentences[2]}"
    docs = [(i, f"{words(rng, 30)} {sentences[i % 3]} {words(rng, 30)}") for i in (1, 2, 3, 11, 12, 13)] + [(i, f"{words(rng, 50)} {passage()} {words(rng, 50)}") for i in (10, 14)]
    for parts in (1, 5, 50):
        got = {r.doc_id: r.spans for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()}
        assert set(got) == {10, 14}
        for spans in got.values():
            start, end = map(int, spans.split(":"))
            assert abs(start - 50) <= 3 and abs(end - 142) <= 3


def changed(rng, text, every, spread_evenly):
    w = text.split()
    at = range(every // 2, len(w), every) if spread_evenly else rng.sample(range(len(w)), len(w) // every)
    for i in at:
        w[i] = words(rng, 1) + "q"
    return " ".join(w)


@pytest.mark.parametrize("parts", [1, 7])
def test_recall_of_fuzzy_passages(spark, parts):
    """Planted pairs against each other: passages of 45 to 90 words that agree in 0.83 to 0.95 of their words."""
    rng = random.Random(43)
    rows, want = [], collections.defaultdict(list)
    for g in range(240):
        every, size = (6, 8, 10, 20)[g % 4], (45, 60, 90)[g % 3]
        text = words(rng, size)
        rows += [(10 * g, f"{words(rng, 60)} {text} {words(rng, 60)}"), (10 * g + 1, f"{words(rng, 40)} {changed(rng, text, every, g % 2)} {words(rng, 70)}")]
        want[every].append(10 * g)
    got = {r.doc_id: r.class_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    found = {every: sum(got.get(i) == got.get(i + 1) == i for i in ids) / len(ids) for every, ids in want.items()}
    print(found)
    assert found[20] >= 0.95 and found[10] >= 0.95 and found[8] >= 0.9 and found[6] >= 0.85
    assert all(c // 10 == i // 10 for i, c in got.items())


@pytest.mark.parametrize("copied", [False, True])
def test_passages_changed_at_even_steps(spark, copied):
    """Runs of 4 or 5 words that are the same between words that differ, so that no seed has a like word next to it; also with the passage in other texts as it is."""
    rng = random.Random(47)
    rows, want = [], []
    for g in range(80):
        every, size = (5, 6)[g % 2], (45, 60, 90)[g % 3]
        text = words(rng, size)
        rows += [(10 * g, f"{words(rng, 60)} {text} {words(rng, 60)}"), (10 * g + 1, f"{words(rng, 40)} {changed(rng, text, every, True)} {words(rng, 70)}")]
        rows += [(10 * g + i, f"{words(rng, 30)} {text} {words(rng, 30)}") for i in (2, 3) if copied]
    rows += [(10_000 + i, rows[i][1]) for i in range(0, 20, 2)]  # equal texts
    got = {r.doc_id: r.class_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(got.get(10 * g) == got.get(10 * g + 1) == 10 * g for g in range(80)) >= 76
    assert all(got[i] == got[rows[i - 10_000][0]] for i in range(10_000, 10_020, 2))


def common_run(a, b, size=passages.MIN_WORDS, least=passages.IDENTITY):
    """Do any two stretches of ``size`` words agree in a share ``least``, by the longest common subsequence of all pairs of them?"""
    for j in range(len(b) - size + 1):
        at = collections.defaultdict(int)
        for n, w in enumerate(b[j : j + size]):
            at[w] |= 1 << n
        for i in range(len(a) - size + 1):
            if sum(w in at for w in a[i : i + size]) < least * size:
                continue
            row = 0
            for w in a[i : i + size]:
                x = at[w] | row
                row = x & ((x - ((row << 1) | 1)) ^ x)
            if row.bit_count() >= least * size:
                return True
    return False


def test_fuzzy_passages_against_all_pairs_of_stretches(spark):
    rng = random.Random(83)
    rows = []
    for g in range(30):
        text = words(rng, rng.choice((48, 60, 75, 25)))
        other = changed(rng, text, rng.choice((8, 10, 20)), g % 2) if g % 3 else words(rng, 50)
        rows += [(10 * g, f"{words(rng, 20)} {text} {words(rng, 25)}"), (10 * g + 1, f"{words(rng, 30)} {other} {words(rng, 15)}")]
    want = {g for g in range(30) if common_run(rows[2 * g][1].split(), rows[2 * g + 1][1].split())}
    got = {r.doc_id: r.class_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i // 10 for i in got}
    assert all(c // 10 == i // 10 for i, c in got.items())
    assert len(want) >= 10 and len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(found)


def test_rows_of_one_id_are_held_apart(spark):
    rng = random.Random(47)
    passage = words(rng, 60)
    rows = [(1, f"{passage} {words(rng, 20)}"), (1, words(rng, 80)), (None, words(rng, 80)), (None, f"{words(rng, 20)} {passage}"), (None, f"{words(rng, 20)} {passage}") ]
    rows.append(rows[-1])
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == [(1, 1), (None, 1), (None, 1)]


def test_odd_rows_do_not_break_passages(odd):
    got = {r.doc_id: r.class_id for r in passages.repeated(odd).collect()}
    assert got[4] == got[6] == got[13] == 4 and got[7] == got[8] == 7 and 2 not in got


class Sent:
    """A broadcast filter that holds all seeds, or those whose hashes a number divides."""

    def __init__(self, by=1):
        self.value, self.by = self, by

    def holds(self, h):
        return h % np.uint64(self.by) == 0


def test_texts_that_are_hashed_at_once_are_held_apart(monkeypatch):
    """The steps of many short texts at once, in few calls, against each text alone."""
    import pyarrow as pa

    rng = random.Random(97)
    texts = ["", " ", "x", "x x x x x", "x x x x x x", "x", " \n\t x", "É é\u2003ß İ", "a" * 300, "b" + " " * 400 + "c d e f"]
    texts += [rng.choice(texts) if i % 5 == 0 else words(rng, rng.choice((1, 3, 4, 5, 45, 90))) for i in range(300)]
    batch = lambda lo, hi: pa.RecordBatch.from_pydict({"id": pa.array(range(lo, hi), pa.int64()), "t": texts[lo:hi]})
    calls, alone = [], passages.shingles
    monkeypatch.setattr(passages, "shingles", lambda *a: calls.append(1) or alone(*a))
    ids = Sent()
    ids.value = np.full(8, 255, np.uint8)

    def counted(b):
        return [(r, x) for got in passages._counted(7)([b.select(["t"])]) for r, v in zip(*got.to_pydict().values(), strict=True) for x in np.frombuffer(v, "<u4").tolist()]

    def seen(b):
        return [(r, x) for got in passages._occurrences(Sent(3), 7)([b]) for r, v in zip(*got.to_pydict().values(), strict=True) for x in np.frombuffer(v, passages._SEED).tolist()]

    def again(by):
        def run(b):
            rows = [tuple(r.values()) for got in passages._again(Sent(), Sent(by), ids, 7)([b]) for r in got.to_pylist()]
            return [(r[0], x) for r in rows if r[1] for x in np.frombuffer(r[1], passages._RUN).tolist()] + [r[2:] for r in rows if r[1] is None]

        return run

    for step in (counted, seen, again(1), again(5)):
        calls.clear()
        together = step(batch(0, len(texts)))
        assert len(calls) <= 3
        each = [r for i in range(len(texts)) for r in step(batch(i, i + 1))]
        assert len(each) > 300 and collections.Counter(map(repr, together)) == collections.Counter(map(repr, each))


def test_tasks_grow_with_the_text_and_a_bucket_is_linked_in_parts(spark, monkeypatch):
    """What a task holds at once stays the same when a table grows: texts have more tasks, and a large bucket gives the same links in parts."""
    import pyarrow as pa

    monkeypatch.setattr(passages, "TASK_BYTES", 1000)
    texts = lambda n: spark.createDataFrame([(i, "x" * 500) for i in range(n)], "id long, t string")
    assert [passages.tasks_of(texts(n)) for n in (1, 200, 2000)] == [32, 100, 1000]
    rng = np.random.default_rng(3)
    rows = np.zeros(150_000, passages._SEED)
    rows["rest"], rows["id"] = rng.integers(0, 50_000, len(rows)), rng.integers(0, 1000, len(rows))
    rows["at"], rows["left"], rows["right"] = rng.integers(0, 99, len(rows)), rng.integers(1 << 60, 1 << 61, len(rows)), rng.choice(rng.integers(1 << 60, 1 << 61, 20), len(rows))
    calls, alone = [], passages.linked
    monkeypatch.setattr(passages, "linked", lambda part: calls.append(len(part)) or alone(part))
    links = [b for b in passages._linked(7)([passages.packed(np.zeros(len(rows), np.int32), rows)]) if b.column("id").null_count == 0]
    assert sum(calls) == len(rows) and max(calls) < 40_000
    whole = alone(rows)
    assert sum(b.num_rows for b in links) == len(whole[1]) > 1000


def test_all_pairs_of_many_occurrences_of_a_seed():
    """However many there are: against each pair compared, and no seed of a passage is left out for the words round it."""
    assert len(passages.within(np.zeros(100, np.int64))[0]) == 100 * 99 // 2
    rng = np.random.default_rng(5)
    pack = lambda a: np.bitwise_or.reduce(a.astype(np.uint64) << (4 * np.arange(15, -1, -1)).astype(np.uint64), axis=1)
    n = 700
    base = rng.integers(1, 16, (10, 20))

    def side():
        out = np.array([base[k][s : s + 16] for k, s in zip(rng.integers(0, 10, n), rng.integers(0, 3, n), strict=True)])
        out = np.where(rng.random((n, 16)) < rng.choice([0, 0.2, 0.35, 0.6], (n, 1)), rng.integers(1, 16, (n, 16)), out)
        return pack(np.where((rng.random((n, 1)) < 0.2) & (np.arange(16) >= rng.integers(5, 16, (n, 1))), 0, out))

    left, right = side(), side()
    left[:100], right[50:150] = left[100:200], right[200:300]
    left[300:340], right[320:360] = left[340], right[340]
    group, doc, root = np.sort(rng.integers(0, 3, n)), rng.integers(0, 400, n), rng.integers(0, 2, n) * rng.integers(1, 6, n)
    got = {(min(p), max(p)) for i, j, _, _ in passages.rest_of(group, doc, root, left, right) for p in zip(i.tolist(), j.tolist(), strict=True)}
    i, j = np.triu_indices(n, 1)
    a, b = passages.alike(left[i], left[j]), passages.alike(right[i], right[j])
    want = ((a >= 10) & (a < 16)) | ((b >= 10) & (b < 16)) | ((a == 16) & (b == 16))
    want &= (group[i] == group[j]) & (doc[i] != doc[j]) & ((root[i] != root[j]) | (root[i] == 0))
    assert got == set(zip(i[want].tolist(), j[want].tolist(), strict=True)) and len(got) > 1000

    lost = links = 0
    for trial in range(200):  # passages of 40 words, 8 of which differ
        x = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        y = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        y[80:120] = x[80:120]
        y[80 + (rng.choice(np.arange(1, 39), 8, replace=False) if trial % 2 else np.arange(4, 40, 5))] += np.uint64(1 << 32)
        begin, at = np.array([0, 200]), np.flatnonzero(np.convolve(x == y, np.ones(4), "valid") == 4)
        sides = [np.stack(v, 1).ravel() for v in zip(*(passages.around(w, begin, at, np.zeros(len(at), np.int64), 3) for w in (x, y)), strict=True)]
        may = passages.may_pass(sides, np.arange(0, 2 * len(at), 2), np.arange(1, 2 * len(at), 2))
        links, lost = links + len(at), lost + (~may).sum()
    assert links > 1000 and not lost


def test_chains_are_the_best_ones():
    import numpy as np

    x, y = np.array([0, 10, 20, 5, 30]), np.array([100, 110, 120, 3, 130])
    assert passages.chains(x, y) == [[0, 1, 2, 4], [3]]


def test_common_words():
    import numpy as np

    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(np.array(a), np.array(b)) == table[-1][-1]


# --- vectors ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, cluster string, score string, place string"


def vector_rows(n=300, size=64, seed=3, big=False):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, size))
    m = (centers[rng.integers(0, 9, n)] + 0.4 * rng.normal(size=(n, size))).astype(np.float32)
    if big:
        m[::7] *= np.float32(1e7)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(n // 3)]  # a third of all rows is one vector
    rows += [rows[2], rows[2]]  # repeated rows
    return rows


def odd_vectors(size=64):
    return [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [float("nan")] * size), (2004, [float("inf")] + [0.0] * (size - 1)), (2005, [None] + [0.5] * (size - 1)), (None, [0.25] * size)]


def framed(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)


def whole(v):
    return [math.floor(1024 * float(x)) for x in v]


def plain_clusters(rows, k, rounds, seed=3):
    rows = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(rows, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in rows]
    for _ in range(rounds):
        at = near()
        for j in range(len(centers)):
            own = [v for (_, v), (_, a) in zip(rows, at, strict=True) if a == j]
            if own:
                centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(rows, near(), strict=True)], centers


@pytest.mark.parametrize(("parts", "big"), [(1, False), (5, False), (3, True)])
def test_clusters_equal_plain_rounds(spark, parts, big):
    rows = vector_rows(big=big) + odd_vectors()
    got = zone_maps.clustered(framed(spark, rows).repartition(parts), rounds=4).collect()
    want, centers = plain_clusters(rows, 8, 4)
    cut = lambda x: min(x, (1 << 63) - 1)
    order = lambda r: (r[0] is None, *((x or 0) for x in r))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(((i, j, cut(d)) for i, j, d in want), key=order)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    inertia = [sum(d for _, j, d in want if j == k) for k in range(len(centers))]
    assert all(r.centroid_sha256 == names[r.cluster] and r.cluster_inertia == cut(inertia[r.cluster]) and r.inertia == cut(sum(inertia)) for r in got)


def test_clusters_of_few_and_no_vectors(spark):
    rows = vector_rows()[:3]
    got = {r.vec_id: (r.cluster, r.distance) for r in zone_maps.clustered(framed(spark, rows)).collect()}
    assert sorted(c for c, _ in got.values()) == [0, 1, 2] and {d for _, d in got.values()} == {0}
    assert zone_maps.clustered(framed(spark, [])).count() == 0 == zone_maps.clustered(framed(spark, odd_vectors()[:-1])).count()


def test_boxes_rule_out_centroids(spark):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(1).normal(size=(20_000, 2)).astype(np.float32).tolist())]
    seen = []
    zone_maps.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), size=2, k=40, rounds=2, watch=lambda n, sums: seen.append(sums[0, zone_maps.COMPARED]))
    assert len(seen) == 2 and max(seen) < 0.5 * len(rows) * 40
    for _ in range(200):
        low, high = np.sort(np.random.default_rng(_).integers(-50, 50, (2, 3)), axis=0)
        centers = np.random.default_rng(_ + 1000).integers(-80, 80, (6, 3))
        inside = np.random.default_rng(_ + 2000).integers(low, high + 1, (40, 3))
        at, _far = zone_maps.nearest(inside, centers, np.arange(6))
        assert set(at) <= set(zone_maps.candidates(low, high, centers))


def test_hilbert_neighbours_are_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = zone_maps.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        line = cells[np.argsort(keys)]
        assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def plain_top(vectors, asked, k):
    good = [(i, whole(v)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({q: v for q, v in asked}.items()):
        v = whole(v)
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in good if i != q))[:k]
        out += [(q, n, None if none else i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, none, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize(("parts", "query_rows", "big"), [(1, 8192, False), (4, 3, False), (3, 8192, True)])
def test_top_scores_equal_all_pairs(spark, parts, query_rows, big):
    rows = vector_rows(big=big) + odd_vectors()
    asked = [r for r in rows if r[0] is not None and r[0] % 25 == 0 and r[0] < 2000]
    vectors, ask = framed(spark, rows).repartition(parts), framed(spark, [*asked, asked[0], (2000, None), (None, [1.0] * 64)])
    got = [tuple(r) for r in max_score.top_inner(vectors, ask, 7, query_rows, seed_rows=20).sort("query_id", "rank").collect()]
    assert got == plain_top(rows, asked, 7)


def test_top_scores_of_few_and_no_vectors(spark):
    two = framed(spark, [(0, [1.0, 2.0]), (100, [3.0]), (7, [])])
    got = [tuple(r) for r in max_score.top_inner(two, two.where("vec_id % 100 = 0"), 10).sort("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 3 * 1024 * 1024), (0, 2, 7, 0), (100, 1, 0, 3 * 1024 * 1024), (100, 2, 7, 0)]
    assert max_score.top_inner(two.limit(0), two).count() == 0 == max_score.top_inner(two, two.limit(0)).count()


def test_non_essential_lists_are_left_out():
    rng = np.random.default_rng(4)
    cells = rng.integers(-50, 50, (4000, 32)) * (2.0 ** -np.arange(32) * 1000 + 1).astype(int)
    shard = max_score.Shard(np.arange(4000), cells)
    query = (cells[17] // 10).astype(float)
    everything, _ = shard.best(-1, query, 10, None)
    least = everything[-1][0]
    some, looked = shard.best(-1, query, 10, least)
    assert some == everything and looked < 0.5 * cells.size
    assert integers.longs([1 << 70, -(1 << 70), 3]) == [(1 << 63) - 1, -(1 << 63), 3]


# --- merkle -----------------------------------------------------------------------------------


def plain_tree(leaves):
    """(root, each leaf's siblings up to the root as (left, right))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a - a % 8 : a - a % 8 + 8]
            paths[i].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
            at[i] = a // 8
        level = [merkle.digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    said = lambda vs: merkle.digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs))
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = collections.defaultdict(list)
    for i, source, lang, n, text in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees[lang].append((i is not None, i or 0, said((i, source, lang, n, text)), said((i, source, lang, n, low(text) if hit else text))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort()
        built[lang] = plain_tree([t[2] for t in trees[lang]])
    root, tops = plain_tree([built[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, tops, strict=True):
        sub, paths = built[lang]
        for (known, i, leaf, now), path in zip(trees[lang], paths, strict=True):
            folded = merkle.folded(now, path + above)
            out.append((i if known else None, leaf, sub, root, merkle.digest(*(d for s in path + above for d in s)), folded, folded == root))
    return out


DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string, tree string, root string, idx long"


@pytest.mark.parametrize("parts", [1, 6])
def test_manifest_equals_plain_trees(spark, parts, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", None]), rng.choice(["en"] * 700 + ["de"] * 9 + [None] + ["Zz", "é", "z"]), i, rng.choice(["Some Text", "lower", "", None, "É X"])) for i in range(1500)]
    rows += [(3, "web", "en", 1, "Again"), (3, "web", "en", 1, "Again"), (None, None, None, None, None), (None, "s", "en", 1, "No Id"), (77_777, "s", "lone", 1, "X" * 200_000)]
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], DOCUMENT).repartition(parts)
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted((tuple(r) for r in merkle.verified(docs).collect()), key=order)
    assert got == sorted(plain_manifest(rows), key=order)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_none_and_one(spark):
    assert merkle.verified(spark.createDataFrame([], DOCUMENT)).count() == 0
    one = merkle.verified(spark.createDataFrame([(1, "s", "en", 1, "t", "", "", 1)], DOCUMENT)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == merkle.digest("")


def test_positions_are_those_of_the_log():
    for n in [*range(1, 80), 511, 512]:
        levels = merkle.height(n)
        leaves = [merkle.digest(str(i)) for i in range(n)]
        log = merkle.append_log(leaves, levels)
        level, places = leaves, set()
        for k in range(levels + 1):
            for i, d in enumerate(level):
                places.add(at := merkle.position(k, i, n, levels))
                assert log[at] == d
            level = [merkle.digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
        assert places == set(range(len(log))) and merkle.position(levels, 0, n, levels) == len(log) - 1


def test_queries_of_this_round_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op11_centroid_clusters", "op12_merkle_manifest", "op13_top_inner_products"):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(queries.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall()), name

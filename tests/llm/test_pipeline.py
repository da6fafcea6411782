"""The corpus pipeline against a plain version of it, and odd documents through every stage."""

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from scrubline.llm import byte_bpe, queries, toxicity

from .test_operators import odd_rows, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "byte_bpe"]
    docs = spark.createDataFrame([r[:2] + ("en", "s", 1) for r in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_run_equals_the_plain_pipeline(spark):
    docs, labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    # of equal texts the longest, then the first
    best = {}
    for i, t in rows.items():
        key = t.translate(dict.fromkeys([32, *range(9, 14)]))
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(t), i))
    rows = {i: rows[i] for _, i in best.values()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    group = {i: i for i in rows}
    for _ in range(10):
        for i in rows:
            for j in rows:
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    rows = {i: t for i, t in rows.items() if group[i] == i}

    def grams(text):
        import re

        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    tests = [g for r in items.collect() if (g := grams(r.text))]
    rows = {i: t for i, t in rows.items() if not any(len(g & grams(t)) >= 0.8 * len(g) - 1e-9 for g in tests)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        assert r.decoded == rows[i] and list(r.ids) == own.encode_ordinary(rows[i])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(name, spark):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert df.count() > 0

"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

The distinct pre-tokens of a batch are lists of tokens, one token for each byte. A recursive query
spells them out as rows (word, position, token, next token), joins these with the merge table,
contracts each word's leftmost pair of least rank, and goes on until no word has a pair. Decoding is
an aggregation of the tokens' bytes in order. What a query gives is kept by worker, so each
pre-token is encoded about once for each worker.

A query passes over a word's rows once for each round, so the time for a word would grow with the
square of its length. Words over ``LONG_WORD`` bytes therefore go through a query that contracts all
pairs of a word's least rank in one round, wherever that gives the same tokens: a contraction can't
come before another of the same rank unless the new token stands in a pair of lesser rank (such
ranks are marked, and their pairs contracted singly).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, text_of
from .pretokens import Memo, cutter

#: Bytes from which words are contracted at all places of a rank in one round.
LONG_WORD = 64
#: Entries of a worker's cache, about 250 bytes each, twice that many at most; older ones go.
MEMO_WORDS = 80_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1_500_000
#: Words of one recursive query, and their bytes, which bound its memory (in MB; a single longer word gets more).
QUERY_WORDS, QUERY_BYTES = 10_000, 150_000
DUCKDB_MEMORY = 64

#: Rows of pairs (word, a, b, pos) of what a round has.
_PAIRS = "SELECT word, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, generate_subscripts(tokens[2:], 1) AS pos FROM step"

SHORT = f"""
WITH RECURSIVE step(word, tokens) AS (
    SELECT word, tokens FROM start
  UNION ALL
    SELECT s.word, list_concat(list_append(s.tokens[:(best & 4294967295) - 1], (best >> 32)::INTEGER), s.tokens[(best & 4294967295) + 2:])
    FROM step s JOIN (
        SELECT word, min((merged::BIGINT << 32) + pos) AS best FROM ({_PAIRS}) JOIN merges USING (a, b) GROUP BY word) USING (word)
), done AS MATERIALIZED (SELECT word, arg_min(tokens, len(tokens)) AS ids FROM step GROUP BY word)"""

LONG = f"""
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM start
  UNION
    SELECT * FROM (
        WITH ranked AS (SELECT word, pos, merged, calm FROM ({_PAIRS}) JOIN merges USING (a, b)),
        hits AS (
            SELECT r.*, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth
            FROM ranked r JOIN (SELECT word, min(merged) AS merged FROM ranked GROUP BY word) USING (word, merged)),
        -- of pairs that overlap, as in a run of one token, every other one
        turns AS (SELECT *, row_number() OVER (PARTITION BY word, pos - nth ORDER BY pos) AS turn FROM hits),
        taken AS (SELECT word, pos, merged FROM turns WHERE turn % 2 = 1 AND (calm OR nth = 1)),
        flat AS (SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM step SEMI JOIN taken USING (word))
        SELECT word, list(coalesce(t.merged, f.token) ORDER BY f.pos) AS tokens
        FROM flat f ANTI JOIN (SELECT word, pos + 1 AS pos FROM taken) g USING (word, pos) LEFT JOIN taken t USING (word, pos)
        GROUP BY word)
), done AS MATERIALIZED (SELECT word, tokens AS ids FROM step)"""

DECODE = """, said AS (
    SELECT word, list(hex ORDER BY i) AS hex
    FROM (SELECT word, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM done) JOIN vocabulary USING (token) GROUP BY word)
SELECT array_to_string(ids, ',') AS ids, array_to_string(hex, '') AS hex FROM done JOIN said USING (word) ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes and decodes words by the ranks of a file; made once for each worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        ranks = read_ranks(path)
        self.cut = cutter(pattern)
        self.memo = Memo(MEMO_WORDS)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{DUCKDB_MEMORY}MB", "temp_directory": ""})
        pairs = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        vocabulary = pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "hex": [b.hex() for b in ranks]})
        hasty = {x for a, b, r in pairs for x in (a, b) if r < x}  # tokens in a pair that comes before they do
        merges = pa.table([*(pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)), pa.array([r not in hasty for _, _, r in pairs])], ["a", "b", "merged", "calm"])
        for name, t in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", t)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def coded(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """(ids joined by commas, bytes decoded from them) of each word; an empty one has none."""
        out: list[tuple[str, bytes]] = [("", b"")] * len(words)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            query, hi, held = (SHORT if len(words[order[lo]]) <= LONG_WORD else LONG), lo, 0
            while hi < len(order) and hi - lo < QUERY_WORDS and (hi == lo or held + len(words[order[hi]]) <= QUERY_BYTES) and (query is LONG or len(words[order[hi]]) <= LONG_WORD):
                held += len(words[order[hi]])
                hi += 1
            if held > QUERY_BYTES:
                self.db.execute(f"SET memory_limit = '{DUCKDB_MEMORY + held // 2000}MB'")
            part = [words[i] for i in order[lo:hi]]
            ends = np.concatenate([[0], np.cumsum([len(w) for w in part])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[np.frombuffer(b"".join(part), dtype=np.uint8)]))
            self.db.register("start", pa.table({"word": pa.array(range(len(part)), pa.int32()), "tokens": tokens}))
            for i, (ids, text) in zip(order[lo:hi], self.db.execute(query + DECODE).fetchall(), strict=True):
                out[i] = ids, bytes.fromhex(text)
            self.db.unregister("start")
            lo = hi
        return out

    def learn(self, new: set[str]) -> None:
        """Put (ids, decoded bytes) of new words into the memo."""
        words = list(new)
        self.memo.update(zip(words, self.coded([w.encode() for w in words]), strict=True))

    def texts(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids joined by commas, how many, decoded bytes) of each text; new words of all are learned together."""
        cuts = list(map(self.cut, texts))
        if new := self.memo.wanted(w for c in cuts for w in c):
            self.learn(new)
        out = []
        for c in cuts:
            ids, decoded = zip(*map(self.memo.__getitem__, c), strict=True) if c else ((), ())
            joined = ",".join(ids)
            out.append((joined, joined.count(",") + 1 if joined else 0, b"".join(decoded)))
        return out


def slices(texts: list[str], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 64
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: A worker's coder, where it is kept from task to task; one at a time.
_coder: dict[tuple[str, str], Coder] = {}


def _batches_of(batches: Iterator[pa.RecordBatch], path: str, pattern: str, out, keep: bool):
    if (coder := _coder.get((path, pattern))) is None:
        _coder.clear()
        coder = _coder[path, pattern] = Coder(path, pattern)
    try:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                yield out(batch.column(0)[lo:hi], coder.texts(texts[lo:hi]))
    finally:
        if not keep:
            _coder.clear()
            coder.db.close()


def _coded(docs: DataFrame, path: str, pattern: str, out, kind: str, keep: bool) -> DataFrame:
    return mapped(docs.select("doc_id", text_of().alias("text")), lambda b: _batches_of(b, path, pattern, out, keep), kind, rows=2_000)


def encode(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text.

    ``path``: a rank file on every worker, ``pattern``: what cuts texts, ``keep``: workers keep what they have learned (about
    100 MB) when a task ends, for the next one. Null and empty texts have no ids and
    decode to the empty text. Rows keep their number, equal ones and null or repeated doc_ids too; other columns
    are ignored, whatever their names; an empty table gives an empty table. A text of any length is coded whole; the time
    is linear in it but for single words: one of n random letters takes time in the square of n (20,000: half a minute).
    """

    def out(doc_ids, coded):
        ids = [list(map(int, i.split(","))) if i else [] for i, _, _ in coded]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for _, _, d in coded], pa.string())], ["doc_id", "ids", "decoded"])

    return _coded(docs, path, pattern, out, "doc_id long, ids array<int>, decoded string", keep)


def digests(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encode(), with ids and text as their hashes."""

    def out(doc_ids, coded):
        rows = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d).hexdigest()) for i, n, d in coded]
        n, ids, decoded = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(docs, path, pattern, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep)

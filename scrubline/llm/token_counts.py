"""Token counts by a two-tier lookup in the map stage.

First tier: the lengths of the most frequent pre-token pieces of all documents, as sorted 64-bit
hashes with a length each, the same for every worker. Its size is fixed (``TABLE_PIECES``, 9 bytes
a piece). Second tier: a worker's cache; a piece in neither goes to the tokenizer. No pre-tokens are
shuffled: for the first tier, partitions send counts of their own most frequent pieces only. What
is in the table decides speed and never a count.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_of
from .pretokens import Memo, pieces_of, spelled

#: Pieces in the broadcast table, and those that a partition names for it.
TABLE_PIECES, NAMED_PIECES = 16_384, 4_096
#: Distinct pieces that a partition counts at once before it lets go of the rarest.
COUNTED_PIECES = 400_000
MEMO_PIECES = 250_000
SLICE_CHARS = 4_000_000


def _hash(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(pieces_of(text) or ())
            if len(counts) > COUNTED_PIECES:
                counts = Counter(dict(counts.most_common(COUNTED_PIECES // 4)))
    top = counts.most_common(NAMED_PIECES)
    yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


class Counting:
    """The tokenizer of a file with both tiers; made once for each worker."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo = Memo(MEMO_PIECES)
        self.hashes, self.lengths = table or (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.splits = path.endswith(".json")
        if self.splits:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            kind = json.loads(self.tokenizer.to_str())
            # pieces are pre-tokens only where spaces begin them; other tokenizers get whole texts
            self.splits = (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and kind.get("normalizer") is None and not kind["pre_tokenizer"]["add_prefix_space"]
        else:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths_of(self, texts: list[str]) -> list[int]:
        if hasattr(self.tokenizer, "encode_batch"):
            return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [len(e) for e in self.tokenizer.encode(texts, num_threads=1)]

    def learn(self, new: set[str]) -> None:
        pieces = list(new)
        at = np.zeros(len(pieces), np.int64)
        found = np.zeros(len(pieces), bool)
        if len(self.hashes):
            hashes = np.fromiter(map(_hash, pieces), np.uint64, len(pieces))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
        missed = [p for p, f in zip(pieces, found, strict=True) if not f]
        self.memo.update(zip(missed, self.lengths_of(list(map(spelled, missed))) if missed else (), strict=True))
        for p, f, i in zip(pieces, found, at, strict=True):
            if f:
                self.memo[p] = int(self.lengths[i])

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens each whole text has."""
        parts = [pieces_of(t) if self.splits else None for t in texts]
        if new := self.memo.wanted(x for p in parts if p is not None for x in p):
            self.learn(new)
        whole = [i for i, p in enumerate(parts) if p is None]
        out = [0 if p is None else sum(map(self.memo.__getitem__, p)) for p in parts]
        for i in whole:  # one at a time: such texts may be long
            out[i] = self.lengths_of([texts[i]])[0]
        return out


_counting: dict[str, Counting] = {}


def frequent_lengths(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, lengths) of the most frequent pieces of all documents; two pieces of one hash are left out."""
    named = mapped(docs.select(text_of().alias("text")), _named, "piece string, n long")
    top = [r[0] for r in named.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_PIECES).collect()]
    lengths = Counting(path).lengths_of(list(map(spelled, top))) if top else []
    by: dict[int, int] = {}
    clash = set()
    for p, n in zip(top, lengths, strict=True):
        clash |= {h for h in [_hash(p)] if h in by}
        by[_hash(p)] = n
    hashes = np.array(sorted(by.keys() - clash), np.uint64)
    return hashes, np.array([by[int(h)] for h in hashes], np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; null text is empty: 0 bytes, 0 tokens.

    ``path``: a file of the tokenizers library (.json) or of sentencepiece (.model), on every worker.
    Equal rows stay apart, null and repeated doc_ids too, other columns are ignored, an empty table gives an empty table. Texts
    are counted whole, however long: a batch holds few of them, and a text is cut into pieces that are counted one by one.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    splits = Counting(path).splits
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path) if splits else None)

    job = uuid.uuid4().hex  # a worker keeps its caches for one call

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (counting := _counting.get(job)) is None:
            _counting.clear()
            counting = _counting[job] = Counting(path, table.value)
        for batch in batches:
            texts, n, held = batch.column(1).to_pylist(), [], []
            size = 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size > SLICE_CHARS:
                    n += counting.count(held)
                    held, size = [], 0
            n += counting.count(held)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return mapped(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows=2_000)

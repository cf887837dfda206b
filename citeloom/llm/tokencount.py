"""Operator 7: exact token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a document has as many tokens as its
pre-tokens have pieces. Pieces are counted once per distinct pre-token of the corpus, joined
to the pre-token frequencies of the documents, and the products are summed.

A pre-token that is itself an entry of the vocabulary is one piece; that needs no counting
and no join, so those, which are the hot keys, are summed where they are read. What travels is,
for each other pre-token of a batch of documents, one row with the list of documents it
occurs in, as offsets from the batch's first doc_id: the corpus is cut into pre-tokens once. These rows
are shuffled by pre-token and sorted by its hash, so that all of one lie together: its pieces are counted at the
first and joined to the rest as they pass. A pre-token makes one row a batch however often
it occurs, so no key is hot there.

Defined results: one row for each distinct doc_id; rows that repeat a doc_id, or have none,
are summed together; a null or empty text has 0 tokens; an empty table gives no rows. Other columns
are ignored. Whole texts are counted, special tokens' strings as ordinary text.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import text_column, trimmed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPAN = 1 << 31


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=4)
def _whole(path: str) -> frozenset[str]:
    """Vocabulary entries that are text; a pre-token among them is one piece."""
    found = set()
    for piece in _ranks(path):
        try:
            found.add(piece.decode())
        except UnicodeDecodeError:
            continue
    return frozenset(found)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _spans(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of a batch grouped so that the doc_ids of a group differ by less than 2**31."""
    order = np.argsort(ids, kind="stable")
    while len(order):
        far = int(np.searchsorted(ids[order].astype(object) - int(ids[order[0]]), _SPAN)) if int(ids[order[-1]]) - int(ids[order[0]]) >= _SPAN else len(order)
        yield order[:far]
        order = order[far:]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each doc_id."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the pieces of their pre-token; rows come sorted, so each distinct one is counted once."""
        one, last, pieces = encoding(vocabulary, pattern), None, 0
        for batch in batches:
            n = []
            for token in batch.column(0).to_pylist():
                if token != last:
                    last, pieces = token, 0 if token[:1] == "\0" and token[1:].lstrip("-").isdigit() else len(one.encode_ordinary(token))
                n.append(pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int32())], names=[*batch.schema.names[1:], "n"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (pretoken, base, offsets), a document as often as it has the pre-token; and for each document, under a name that spreads them, what it has of whole entries and of pre-tokens."""
        whole, find = _whole(vocabulary), regex.compile(pattern).findall
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            texts = batch.column(1).to_pylist()
            groups = [*_spans_of(ids, np.flatnonzero(known)), *([np.flatnonzero(~known)] if not known.all() else [])]
            for rows in groups:
                base = int(ids[rows].min())
                where: dict[str, list[int]] = {}
                single, every = [], []
                for r in rows.tolist():
                    tokens = find(texts[r])
                    here, offset = 0, int(ids[r]) - base
                    for token, k in Counter(tokens).items():
                        if token in whole:
                            here += k
                        elif k == 1:
                            where.setdefault(token, []).append(offset)
                        else:
                            where.setdefault(token, []).extend([offset] * k)
                    single.append(here)
                    every.append(len(tokens))
                stated = base if known[rows[0]] else None
                sizes = np.cumsum([0, *map(len, where.values())], dtype=np.int32)
                flat = np.fromiter((x for v in where.values() for x in v), np.int32, sizes[-1])
                yield _rows(list(where), stated, sizes, flat, None, None)
                offsets = (ids[rows] - base).astype(np.int32)
                # no pattern class holds both a control character and digits, so no pre-token looks like this
                yield _rows([f"\0{i}" for i in ids[rows].tolist()], stated, np.arange(len(rows) + 1, dtype=np.int32), offsets, single, every)

    def _spans_of(ids: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        for group in _spans(ids[rows]):
            yield rows[group]

    def _rows(tokens: list, base: int | None, sizes: np.ndarray, offsets: np.ndarray, single: list | None, every: list | None) -> pa.RecordBatch:
        # offsets take two bytes where the ids of the batch are that near to each other
        n, near = len(tokens), not len(offsets) or offsets.max() < 1 << 15
        fill = lambda v: pa.array(v, pa.int64()) if v is not None else pa.nulls(n, pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(offsets.astype(np.int16 if near else np.int32)))
        both = [lists, pa.nulls(n, pa.list_(pa.int32()))] if near else [pa.nulls(n, pa.list_(pa.int16())), lists]
        arrays = [pa.array(tokens, pa.string()), pa.array([base] * n, pa.int64()), *both, fill(single), fill(every)]
        return pa.RecordBatch.from_arrays(arrays, names=["pretoken", "base", "near", "far", "single", "every"])

    rows = text.mapInArrow(trimmed(frequencies), "pretoken string, base long, near array<short>, far array<int>, single long, every long")
    # in order of a hash, which sorts faster than strings and brings equal ones together as well
    met = rows.repartition("pretoken").sortWithinPartitions(F.xxhash64("pretoken")).mapInArrow(trimmed(count), "base long, near array<short>, far array<int>, single long, every long, n int")
    each = met.select("base", F.explode(F.coalesce(F.col("near").cast("array<int>"), "far")).alias("o"), "n", "single", "every")
    doc = (F.col("base") + F.col("o")).alias("doc_id")
    return each.groupBy(doc).agg(F.sum("every").alias("n_pretokens"), (F.sum("n") + F.sum("single")).alias("n_tokens"))

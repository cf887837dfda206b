"""Operator 10: vector bin packing of training examples.

Every bin is one training sequence under three simultaneous limits: tokens, segments and
loss-bearing tokens. Bins are filled one at a time by the dot-product heuristic: of the
examples that still fit, take the one whose demand vector, in shares of the limits, has the
greatest dot product with the room that is left. Examples of equal demand are alike to the
heuristic, so it runs over the distinct demands, each with a queue in order of id, and one
placement costs one small matrix product whatever the number of examples. Demands are taken
exactly, not rounded.

Examples are dealt to shards by a hash of their id, the number of shards following the number
of examples (shard_rows each), and each shard is packed by one task. A shard of shard_rows
examples leaves at most a few bins part empty, which is what the sharding costs.

Defined results: an example over a limit by itself has a bin of its own, marked oversize, and
is not cut; one of no tokens still takes a segment; null counts are 0; examples of null id are
left out; rows that repeat an id are packed each; ties go to the lower demand vector, then to
the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import tokencount
from citeloom.llm.common import text_column

MAX_TOKENS = 4096
MAX_SEGMENTS = 32
MAX_LOSS_TOKENS = 3072
SHARD_ROWS = 50_000
_FIELDS = "id long, shard int, bin_no int, position int, tokens long, loss_tokens long, oversize boolean"


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position in the bin) of each example; examples come in order of id."""
    n = len(tokens)
    bins, places = np.zeros(n, np.int32), np.zeros(n, np.int32)
    demand, kind = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    queue = np.argsort(kind, kind="stable")
    count = np.bincount(kind, minlength=len(demand))
    nxt = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.stack([demand[:, 0], np.ones(len(demand), np.int64), demand[:, 1]], axis=1)
    limit = np.array(limits)
    share = size / limit
    over = (size > limit).any(axis=1)
    bin_no = 0
    for k in np.flatnonzero(over):
        for e in queue[nxt[k] : nxt[k] + count[k]]:
            bins[e], bin_no = bin_no, bin_no + 1
    live = np.flatnonzero(~over)
    size, share, count, nxt = size[live], share[live], count[live].copy(), nxt[live].copy()
    while count.any():
        if (count == 0).mean() > 0.5:
            keep = count > 0
            size, share, count, nxt = size[keep], share[keep], count[keep], nxt[keep]
        room, position = limit.copy(), 0
        # demands are sorted by tokens, so those that can fit are a prefix that only shrinks
        while room[1] > 0:
            end = int(np.searchsorted(size[:, 0], room[0], side="right"))
            fits = (count[:end] > 0) & (size[:end, 2] <= room[2])
            if not fits.any():
                break
            score = np.where(fits, share[:end] @ (room / limit), -1.0)
            k = int(score.argmax())
            e = queue[nxt[k]]
            nxt[k] += 1
            count[k] -= 1
            bins[e], places[e] = bin_no, position
            room = room - size[k]
            position += 1
        bin_no += 1
    return bins, places


def pack_examples(
    examples: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_LOSS_TOKENS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, shard, bin_no, position, tokens, loss_tokens, oversize) from (id, tokens, loss_tokens)."""
    limits = (max_tokens, max_segments, max_loss_tokens)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    examples = examples.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), whole("tokens").alias("tokens"), whole("loss_tokens").alias("loss_tokens"))
    shards = max(1, -(-examples.count() // shard_rows))
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("tokens", "ascending"), ("loss_tokens", "ascending")])
        tokens, loss = table["tokens"].to_numpy(), table["loss_tokens"].to_numpy()
        bins, places = pack(tokens, loss, limits)
        over = (tokens > max_tokens) | (loss > max_loss_tokens) | (max_segments < 1)
        shard = np.full(len(tokens), key[0].as_py(), np.int32)
        columns = [table["id"], pa.array(shard), pa.array(bins), pa.array(places), table["tokens"], table["loss_tokens"], pa.array(over)]
        return pa.Table.from_arrays(columns, names=names)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return examples.withColumn("shard", shard).groupBy("shard").applyInArrow(place, _FIELDS)


def _counter(vocabulary: str, pattern: str):
    """Tokens of each text in the vocabulary of `tokencount`; special tokens' strings count as ordinary text."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = tokencount.encoding(vocabulary, pattern)
        for batch in texts:
            yield pd.Series([len(one.encode_ordinary(t)) for t in batch], dtype="int64")

    return count


def conversation_examples(conversations: DataFrame, vocabulary: str = tokencount.VOCABULARY, pattern: str = tokencount.PATTERN) -> DataFrame:
    """(id, tokens, loss_tokens) of each conversation: the tokens of its texts by the vocabulary,
    with two more for the frame of a turn; the assistant's bear loss."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("id"), "role", text_column(conversations).alias("text"))
    turns = turns.select("id", "role", (_counter(vocabulary, pattern)("text") + 2).alias("n"))
    return turns.groupBy("id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("loss_tokens"))


def document_examples(docs: DataFrame, vocabulary: str = tokencount.VOCABULARY, pattern: str = tokencount.PATTERN) -> DataFrame:
    """(id, tokens, loss_tokens) of each row: the tokens of its text by the vocabulary, of which all but the first bear loss.

    A null or empty text has none.
    """
    n = _counter(vocabulary, pattern)(text_column(docs))
    return docs.select(F.col("doc_id").alias("id"), n.alias("tokens")).withColumn("loss_tokens", F.greatest(F.col("tokens") - 1, F.lit(0)))

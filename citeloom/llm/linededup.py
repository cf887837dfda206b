"""Operator 6: near-duplicate lines by a deletion-neighbourhood join, edit bound 1.

Two lines are within one edit if and only if deleting one character at one same place makes
them equal (a substitution), or deleting one character of the longer gives the shorter. A
line emits its variants as hashed keys and lines meet where keys are equal.

A line of n characters has n variants, far too many to emit for lines that are like no other.
So the neighbourhood is emitted in two steps. First whole blocks are deleted: a line cut into
3 blocks gives one key for each block left out and each of the lengths n and n - 1, and of two
lines within one edit some such keys are equal. Only lines that share a block key, and only for
the characters of that block, then emit the deletions of single characters. No pair is lost.

Lines are first reduced to distinct ones, each at its earliest place, so copies cost nothing
more, and within a key only the earliest line is of interest, so each key is one minimum rather
than all pairs of its lines. Minima and counts combine map-side and keys of one line go at once;
the others are joined back to their lines, which a broadcast or AQE's splitting of skewed
partitions spreads, so a key that most lines share is no task's alone.

Candidate pairs are verified by edit distance on their texts. 128 bits of hash tell lines apart.

Defined results: lines are compared without blanks at their ends. One edit is too loose a bound for
lines of fewer than min_chars characters: those are dropped only where an earlier line is equal,
and lines of white space only stay. A null text has no lines; rows of null doc_id are not compared; a
line goes if any earlier line, by (doc_id, line_no), is within the bound, whether or not that one
goes too; rows that repeat a doc_id share their places, and a line is never earlier than its own
place. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import TEXT_ROWS, forget, fresh, small, stored, text_column, trimmed
from citeloom.llm.words import BASE, INVERSE, _power, mix

MIN_CHARS = 20
BLOCKS = 3


def _lines(docs: DataFrame) -> DataFrame:
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_column(docs).alias("t"))
    lines = text.select("doc_id", F.posexplode(F.transform(F.split("t", "\n"), lambda x: F.trim(x))).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\s\x0B]"))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _block_keys() -> F.Column:
    keys, n = [], F.length("line")
    for shorter in (0, 1):
        size = n - shorter
        for s in range(BLOCKS):
            low, high = F.floor(size * s / BLOCKS).cast("int"), F.floor(size * (s + 1) / BLOCKS).cast("int")
            keys.append(F.xxhash64(size, F.lit(s), F.left("line", low), F.right("line", size - high)))
    return F.array(*keys)


def _variants(line: str, wanted: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """(keys, role) for the blocks wanted; roles: 0 substitution, 1 the line itself, 2 one character deleted."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _power(BASE, n), out=sums[1:])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
    same = sorted(i for i in wanted if i < BLOCKS)
    if same:
        yield mix(sums[-1:] + np.uint64(n)), 1
    for i in same:
        at = np.arange(n * i // BLOCKS, n * (i + 1) // BLOCKS)
        yield mix(mix(without[at]) + at.astype(np.uint64) * np.uint64(BASE) + np.uint64(n)), 0
    spans = [range((n - 1) * (i - BLOCKS) // BLOCKS, (n - 1) * (i - BLOCKS + 1) // BLOCKS + 1) for i in wanted if i >= BLOCKS]
    if spans:
        at = np.unique(np.concatenate(spans))
        yield np.unique(mix(without[at] + np.uint64(n - 1))), 2


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of the candidate lines of (doc_id, t, candidates)."""
    for batch in batches:
        keys, roles, docs, numbers, held = [], [], [], [], 0
        for doc, text, candidates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.split("\n")
            for c in candidates:
                if c["line_no"] >= len(lines):  # another row of this doc_id has the line
                    continue
                line = lines[c["line_no"]].strip(" ")
                for k, role in _variants(line, c["blocks"]) if line else ():
                    keys.append(k)
                    roles.append(np.full(len(k), role, np.int8))
                    docs.append(np.full(len(k), doc, np.int64))
                    numbers.append(np.full(len(k), c["line_no"], np.int32))
                    held += len(k)
            if held > 500_000:
                yield _batch(keys, roles, docs, numbers)
                keys, roles, docs, numbers, held = [], [], [], [], 0
        if held:
            yield _batch(keys, roles, docs, numbers)


def _batch(keys: list, roles: list, docs: list, numbers: list) -> pa.RecordBatch:
    columns = [np.concatenate(keys).view(np.int64), np.concatenate(roles), np.concatenate(docs), np.concatenate(numbers)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "role", "doc_id", "line_no"])


def _by_document(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, t, candidates) for the documents that `places` (stored) names."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("t"))
    return text.join(small(places), "doc_id").select("doc_id", "t", "candidates")


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, earlier_doc_id, earlier_line_no) of each line to drop.

    The earlier place is that of the earliest line within one edit, or, for lines of fewer than min_chars characters, equal to it.
    """
    if min_chars < 2 * BLOCKS:
        raise ValueError(f"min_chars must be {2 * BLOCKS} at least, so that no block is empty")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    lines = _lines(docs)
    keys = F.when(F.length("line") >= min_chars, _block_keys())
    firsts = lines.select("h1", "h2", "doc_id", "line_no", keys.alias("keys")).groupBy("h1", "h2")
    firsts = firsts.agg(F.min(F.struct("doc_id", "line_no", "keys")).alias("f"), F.count(F.lit(1)).alias("n")).select("h1", "h2", "n", "f.*")
    firsts = stored(firsts, "lines")

    # block deletions: lines that share a key, and for which blocks
    keyed = firsts.where("keys is not null").select("doc_id", "line_no", F.posexplode("keys").alias("block", "key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared-keys")
    wanted = keyed.join(small(shared), "key").groupBy("doc_id", "line_no").agg(F.collect_set("block").alias("blocks"))
    wanted = stored(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "blocks")).alias("candidates")), "candidates")

    # character deletions within those blocks, joined on equal keys
    variants = stored(_by_document(wanted, docs).mapInArrow(trimmed(_emit), "key long, role byte, doc_id long, line_no int"), "variants", TEXT_ROWS)
    place = F.struct("doc_id", "line_no")
    least = lambda role: F.min(F.when(F.col("role") == role, place))
    met = variants.groupBy("key").agg(least(0).alias("same"), least(1).alias("whole"), least(2).alias("cut"), F.min(place).alias("low"), F.max(place).alias("high"))
    met = stored(met.where("low < high").select("key", "same", "whole", "cut"), "shared-variants")
    met = variants.join(small(met), "key")
    met = met.withColumn("e", F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("cut")).otherwise(F.col("whole")))
    pairs = met.where(F.col("e") < place).select("doc_id", "line_no", F.col("e.doc_id").alias("e_doc"), F.col("e.line_no").alias("e_line")).distinct()
    pairs = stored(pairs, "line-pairs")

    # verification on the texts
    ends = pairs.select("doc_id", "line_no").union(pairs.select("e_doc", "e_line")).distinct()
    ends = stored(ends.groupBy("doc_id").agg(F.collect_list(F.struct("line_no")).alias("candidates")), "line-ends")
    texts = _by_document(ends, docs)
    texts = texts.select("doc_id", F.explode(F.transform("candidates", lambda c: F.struct(c["line_no"].alias("line_no"), F.trim(F.get(F.split("t", "\n"), c["line_no"])).alias("line")))).alias("x"))
    texts = stored(texts.select("doc_id", "x.*").where(F.length("line") >= min_chars), "line-texts")
    near = (
        pairs.join(texts, ["doc_id", "line_no"])
        .join(texts.select(F.col("doc_id").alias("e_doc"), F.col("line_no").alias("e_line"), F.col("line").alias("e_text")), ["e_doc", "e_line"])
        .where(F.expr("levenshtein(line, e_text, 1) between 0 and 1"))
        .groupBy("doc_id", "line_no")
        .agg(F.min(F.struct(F.col("e_doc").alias("doc_id"), F.col("e_line").alias("line_no"))).alias("near"))
    )
    # what each distinct line that repeats another, or is repeated, goes back to
    firsts = firsts.select("h1", "h2", "n", "doc_id", "line_no").join(near, ["doc_id", "line_no"], "left")
    back = stored(firsts.where("n > 1 or near is not null").select("h1", "h2", F.coalesce("near", place).alias("e")), "lines-back")
    forget(variants, wanted, shared)
    gone = lines.select("h1", "h2", "doc_id", "line_no").join(small(back), ["h1", "h2"]).where(F.col("e") < place)
    return gone.select("doc_id", "line_no", F.col("e.doc_id").alias("earlier_doc_id"), F.col("e.line_no").alias("earlier_line_no"))


def without_duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without the duplicate lines; documents of which nothing but blanks is left go.

    Columns stay as they are; n_chars, if there, is counted anew for the changed texts.
    """
    doc, gone_, text = (fresh(docs, n) for n in ("__doc", "__gone", "__text"))
    gone = duplicate_lines(docs, min_chars).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(gone_))
    joined = docs.join(small(stored(gone, "gone")), F.col("doc_id") == F.col(doc), "left")
    whole = F.col(gone_).isNull()
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone_, i)), "\n")
    joined = joined.withColumn(text, F.when(whole, F.col("text")).otherwise(left))
    joined = joined.where(whole | (F.trim(text) != ""))
    changed = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.withColumns(changed).select(*docs.columns)


def oracle(min_chars: int = MIN_CHARS) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, trim(unnest(ls), ' ') AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, length(line) AS n FROM l WHERE regexp_matches(line, '[^\\s\\x0B]')),
f AS (SELECT line, n, min({{'d': doc_id, 'l': line_no}}) AS p FROM k GROUP BY line, n),
e AS (SELECT a.line, min(b.p) AS q FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.p <= a.p
      WHERE a.line = b.line OR (a.n >= {min_chars} AND b.n >= {min_chars} AND levenshtein(a.line, b.line) <= 4 AND list_min([
        CASE WHEN left(a.line, i) = left(b.line, i) AND right(a.line, greatest(a.n, b.n) - i - 1 - (greatest(a.n, b.n) - a.n)) = right(b.line, greatest(a.n, b.n) - i - 1 - (greatest(a.n, b.n) - b.n)) THEN 0 ELSE 1 END
        FOR i IN range(greatest(a.n, b.n))]) = 0 AND a.n = b.n)
         OR (a.n <> b.n AND a.n >= {min_chars} AND b.n >= {min_chars} AND levenshtein(a.line, b.line) <= 4 AND list_contains([
            left(CASE WHEN a.n > b.n THEN a.line ELSE b.line END, i) || substr(CASE WHEN a.n > b.n THEN a.line ELSE b.line END, i + 2)
            FOR i IN range(greatest(a.n, b.n))], CASE WHEN a.n > b.n THEN b.line ELSE a.line END))
      GROUP BY a.line)
SELECT k.doc_id, k.line_no, e.q.d AS earlier_doc_id, e.q.l AS earlier_line_no
FROM k JOIN e USING (line) WHERE e.q < {{'d': k.doc_id, 'l': k.line_no}}"""

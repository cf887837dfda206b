"""Operator 3: classes of documents that pairs with a Jaccard of at least t between their sets of
word n-grams connect, and how many such pairs each is in, by vertical partitioning.

The global order of n-grams is that of their hashes, cut into ranges, the fragments; each
document's set falls into segments. What the fragments count separately is summed: first how
many n-grams of a document occur elsewhere at all, later the overlaps of pairs.

1. Segments are shuffled to their fragments, packed for a slice of documents at a time, at 4 bytes
   an n-gram and a byte a document and fragment at most. A fragment holds every document
   with an n-gram in its range, so document frequencies are exact there. N-grams of one document
   only can be in no overlap and stop here; they still count in the sizes.
2. The segments return to their documents. Since overlap >= t * size is needed, a document with
   fewer n-grams that occur elsewhere has no partner and stops here: most do.
3. Documents of one and the same set are one for the join, with their number as its weight.
4. Prefix filter, rarest n-gram first: a pair must share one of each side's first
   size - ceil(t * size) + 1. N-grams that are in one document only come first in that order.
   Pairs also need sizes within t of each other. A group of near copies has pairs as the square of
   its documents, so they are not listed: first each document of an n-gram is paired with the next
   in size and with one that leads, and what holds connects most groups. Then only pairs from
   different groups are candidates, all of them, which makes the classes exact. N-grams of many
   documents are dealt to blocks there, and each two blocks meet by themselves.
5. Candidate pairs and segments meet by cell and range of fragments, so that a segment travels
   once to each cell; partial overlaps are counted there and summed per pair. A component of the
   candidate graph is one cell, or, if it has many pairs, one for each two blocks of its
   documents: the pairs of a cell stay about CELL_PAIRS.
6. A pair's two documents are of one class, so links are counted class by class, all with all: small
   classes together, each two blocks of a large one by themselves. Only the counts leave.

No step is approximate but for the hashes: an n-gram is known by its fragment and 32 bits in
it while a fragment has about FRAGMENT_GRAMS, so that a pair's count is off with a probability
of the order of 1e-5.

Defined results: words are as in `words`; a text of fewer than n words is one n-gram, one of
no words has no partner; null texts count as empty; rows of null doc_id are left out; rows that
repeat a doc_id are one document, of their distinct texts in order; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import TEXT_ROWS, forget, fresh, small, stored, text_column, trimmed, trimmed_batches, trimmed_group
from citeloom.llm.components import connected_components
from citeloom.llm.words import distinct_grams, gram_hashes, mix, word_runs

N = 3
THRESHOLD = 0.5
FRAGMENT_GRAMS = 2_000_000
SLICE_RUNS = 8
#: Ranges of fragments whose overlaps are counted apart.
PARTS = 4
#: Documents that one n-gram brings together in one place, and pairs and documents of one cell, about.
HOT = 4096
CELL_PAIRS = 100_000
CELL_DOCUMENTS = 10_000
#: N-grams that a step takes at a time, candidate pairs that it holds, and documents of a block of a large class, about.
STEP_GRAMS = 1_000_000
HELD_PAIRS = 1_000_000
#: Rows that a batch from Python to the JVM has at most, which holds it outside its heap.
SENT_ROWS = 65_536
BLOCK = 2048


def _pack(a: np.ndarray, dtype) -> bytes:
    return a.astype(dtype).tobytes()


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _pack_counts(per: np.ndarray) -> tuple[int, bytes]:
    """How many n-grams each document of a slice has here: as counts of 1 or 2 bytes, or, where most have none, as its number repeated."""
    if per.sum() * 2 < len(per) and len(per) <= 1 << 16:
        return 0, _pack(np.repeat(np.arange(len(per)), per), np.uint16)
    width = 1 if per.max() < 1 << 8 else 2 if per.max() < 1 << 16 else 4
    return width, _pack(per, f"<u{width}")


def _documents(form: int, raw: bytes) -> np.ndarray:
    """The number in its slice of the document of each n-gram."""
    if not form:
        return np.frombuffer(raw, np.uint16).astype(np.int32)
    per = np.frombuffer(raw, f"<u{form}")
    return np.repeat(np.arange(len(per), dtype=np.int32), per)


def _arrays(rows: list[tuple], types: tuple, names: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


def _segments(fragments: int, n: int):
    """Packed segments of slices of documents by fragment; and once for each slice, on its way to the same place, the documents' ids and sizes."""

    def pack(number: int, ids: np.ndarray, grams: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        g, size = np.concatenate(grams), np.concatenate(sizes)
        fragment = (((g >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        rest, doc = g.astype(np.uint32)[order], np.repeat(np.arange(len(ids), dtype=np.int32), size)[order]
        ends = np.cumsum(np.bincount(fragment, minlength=fragments))
        rows = [(number % fragments, number, -1, ids.tobytes(), _pack(size, np.uint32))]
        for f, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if y > x:
                rows.append((f, number, *_pack_counts(np.bincount(doc[x:y], minlength=len(ids))), rest[x:y].tobytes()))
        return _arrays(rows, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), "fragment slice form docs grams")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            grams, sizes, begun = [], [], 0
            for _, j, words, offsets, *_ in word_runs(batch.column(1)):
                g, at = distinct_grams(*gram_hashes(words, offsets, n))
                grams.append(g)
                sizes.append(np.diff(at))
                if len(grams) == SLICE_RUNS or j == len(ids):
                    yield pack(number, ids[begun:j], grams, sizes)
                    grams, sizes, begun, number = [], [], j, number + 1

    return cut


def _frequent(key: tuple, table: pa.Table) -> pa.Table:
    """Within one fragment: which n-grams more than one document has, returned to their slices with a class of their frequency."""
    rows = list(zip(*(table[c].to_pylist() for c in ("slice", "form", "docs", "grams")), strict=True))
    out = [(s, -1, -1, d, g, b"") for s, form, d, g in rows if form < 0]
    rows = [r for r in rows if r[1] >= 0]
    parts = [np.frombuffer(g, np.uint32) for *_, g in rows]
    grams = np.concatenate([np.zeros(0, np.uint32), *parts])
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    run = np.diff(np.concatenate([np.flatnonzero(first), [len(g)]]))
    # only the order matters later, so a byte of logarithm will do
    rank = np.minimum(np.log2(np.maximum(run, 1)) * 8, 255).astype(np.uint8)
    df = np.empty(len(g), np.uint8)
    df[order] = np.repeat(np.where(run > 1, np.maximum(rank, 1), 0).astype(np.uint8), run)
    at = 0
    for (number, form, docs, _), part in zip(rows, parts, strict=True):
        mine = df[at : at + len(part)]
        at += len(part)
        kept = mine > 0
        if kept.any():
            doc = _documents(form, docs)
            per = np.bincount(doc[kept], minlength=len(docs) // form if form else int(doc.max()) + 1)
            out.append((number, key[0].as_py(), *_pack_counts(per), part[kept].tobytes(), mine[kept].tobytes()))
    types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3)
    return pa.Table.from_batches([_arrays(out, types, "slice fragment form docs grams df")])


def _survivors(threshold: float):
    """Documents of a slice that can have a partner, with their shared n-grams, rarest first."""

    def assemble(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("fragment", "form", "docs", "grams", "df")), strict=True))
        ids, size = next((np.frombuffer(d, np.int64), np.frombuffer(g, np.uint32).astype(np.int64)) for f, _, d, g, _ in rows if f < 0)
        rows = [r for r in rows if r[0] >= 0]
        doc = np.concatenate([np.zeros(0, np.int32), *(_documents(form, d) for _, form, d, _, _ in rows)])
        grams = np.concatenate([np.zeros(0, np.uint64), *((np.uint64(f) << np.uint64(32)) | np.frombuffer(g, np.uint32).astype(np.uint64) for f, _, _, g, _ in rows)])
        df = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for *_, x in rows)])
        have = np.bincount(doc, minlength=len(ids))
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        alive = (have >= least) & (size > 0)
        on = alive[doc]
        doc, grams, df = doc[on], grams[on], df[on]
        order = np.lexsort((grams, df, doc))
        grams, df = grams[order], df[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]).astype(np.int64)
        mixed = mix(grams)
        out = []
        for k in np.flatnonzero(alive).tolist():
            g, m = grams[at[k] : at[k + 1]], mixed[at[k] : at[k + 1]]
            same = (int(m.sum(dtype=np.uint64)) - (1 << 63), int(np.bitwise_xor.reduce(m)) - (1 << 63)) if have[k] == size[k] else (None, None)
            prefix = int(have[k] - least[k] + 1)
            out.append((int(ids[k]), int(size[k]), *same, df[at[k] : at[k + 1]][:prefix].tobytes(), g.tobytes()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_batches([_arrays(out, types, "doc_id size h1 h2 ranks grams")])

    return assemble


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of SENT_ROWS, one at least."""
    for k in range(0, max(1, batch.num_rows), SENT_ROWS):
        yield batch.slice(k, SENT_ROWS)


def _prefixes(buckets: int):
    """The n-grams of documents' prefixes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, group = (batch.column(k).to_numpy() for k in range(3))
            n = np.array([len(r) for r in batch.column(3).to_pylist()], np.int64)
            g = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(g, np.uint64, k) for g, k in zip(batch.column(4).to_pylist(), n, strict=True))])
            bucket = (mix(g) % np.uint64(buckets)).astype(np.int32)
            columns = [bucket, g.view(np.int64), *(np.repeat(c, n) for c in (ids, size, group))]
            yield from _sent(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "gram", "doc_id", "size", "group"]))

    return emit


def _lists(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    start = np.flatnonzero(new)
    return start, np.diff(np.concatenate([start, [n]]))


def _leads(threshold: float):
    """Of each n-gram's documents the pairs of each with the next in size, and with the one of least hash, which leads many n-grams."""

    def pair(key: tuple, table: pa.Table) -> pa.Table:
        gram, doc, size = (table[c].to_numpy() for c in ("gram", "doc_id", "size"))
        ids, doc = np.unique(doc, return_inverse=True)
        by = mix(ids.astype(np.uint64))
        order = np.lexsort((by[doc], size, gram))
        gram, doc, size = gram[order], doc[order], size[order]
        start, n = _lists(gram)
        least = np.lexsort((by[doc], gram))[start] if len(gram) else start
        sizes = np.zeros(len(ids), np.int64)
        sizes[doc] = size
        follows = np.flatnonzero(gram[1:] == gram[:-1])
        x, y = np.concatenate([doc[follows], doc[np.repeat(least, n)]]), np.concatenate([doc[follows + 1], doc])
        a, b = np.minimum(x, y), np.maximum(x, y)
        ok = (a != b) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
        pairs = np.unique((a * len(ids) + b)[ok])
        a, b = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        return pa.Table.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return pair


def _meetings(buckets: int, hot: int):
    """The postings of n-grams that documents of different groups have; those of many documents once for each two blocks of these.

    side is 0 where all documents of a list meet, else 1 or 2, which only meet each other.
    """

    def emit(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, doc, size, group = (table[c].to_numpy() for c in ("gram", "doc_id", "size", "group"))
        order = np.lexsort((group, gram))
        gram, doc, size, group = gram[order], doc[order], size[order], group[order]
        start, n = _lists(gram)
        apart = group[start] != group[start + n - 1]

        def batch(g: np.ndarray, at: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            columns = [(mix(g) % np.uint64(buckets)).astype(np.int32), g.view(np.int64), doc[at], size[at], group[at], side]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "gram", "doc_id", "size", "group", "side"])

        plain = apart & (n <= hot)
        at = np.repeat(start[plain], n[plain]) + _runs(n[plain])
        yield from _sent(batch(gram[at].view(np.uint64), at, np.zeros(len(at), np.int8)))
        for k in np.flatnonzero(apart & (n > hot)).tolist():
            at = np.arange(start[k], start[k] + n[k])
            blocks = -(-int(n[k]) // hot)
            own = (mix(doc[at].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for other in range(blocks):
                low, high = np.minimum(own, other), np.maximum(own, other)
                side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.int8)
                yield from _sent(batch(mix(gram[at].view(np.uint64) + mix((low * blocks + high).astype(np.uint64) + np.uint64(1))), at, side))

    return emit


def _candidates(threshold: float, held_pairs: int):
    """The pairs of documents of different groups in each list, some at a time; a pair may come again in another part."""

    def pair(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, doc, size, group, side = (table[c].to_numpy() for c in ("gram", "doc_id", "size", "group", "side"))
        ids, doc = np.unique(doc, return_inverse=True)
        order = np.lexsort((group, gram))
        gram, doc, size, group, side = gram[order], doc[order], size[order], group[order], side[order]
        start, n = _lists(gram)
        own, k = _lists(gram, group)
        # a posting meets those of its list that come after its group
        after = np.repeat(own + k, k)
        meets = np.repeat(start + n, n) - after
        total = np.concatenate([[0], np.cumsum(meets)])
        found, held, at, step = [], 0, 0, max(1, held_pairs // 4)

        def batch(pairs: np.ndarray) -> pa.RecordBatch:
            a, b = ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        while at < len(gram):
            end = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
            row = np.repeat(np.arange(at, end), meets[at:end])
            other = after[row] + _runs(meets[at:end])
            ok = (np.minimum(size[row], size[other]) >= threshold * np.maximum(size[row], size[other]) - 1e-9) & ((side[row] == 0) | (side[row] != side[other]))
            x, y = doc[row[ok]], doc[other[ok]]
            del row, other, ok
            found.append(np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y)))
            held += len(found[-1])
            if held > held_pairs:
                found = [np.unique(np.concatenate(found))]
                yield from _sent(batch(found.pop()))
                held = 0
            at = end
        yield from _sent(batch(np.unique(np.concatenate([np.zeros(0, np.int64), *found]))))

    return pair


def _cells(candidates: DataFrame, fragments: int, cell_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cells) of every document of a pair, and (cell, a, b) of every pair; both ends of a pair are in its cell."""
    nodes = stored(connected_components(candidates), "components")
    sizes = candidates.join(small(nodes), F.col("a") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    sizes = stored(sizes.select("component", F.ceil(F.sqrt(F.col("pairs") / cell_pairs)).cast("int").alias("blocks"), "pairs"), "component-sizes")
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    cells = max(fragments, 2 * -(-total // cell_pairs), -(-nodes.count() // CELL_DOCUMENTS))
    block = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.col("blocks")).cast("int")
    cell = lambda x, y: F.pmod(F.xxhash64("component", F.least(x, y), F.greatest(x, y)), F.lit(cells)).cast("int")
    nodes = stored(nodes.join(small(sizes.select("component", "blocks")), "component").withColumn("block", block(F.col("node"))), "blocks")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: cell(F.col("block"), j))
    placed = nodes.select(F.col("node").alias("doc_id"), F.array_distinct(every).alias("cells"))
    wanted = candidates.join(small(nodes), F.col("a") == F.col("node")).select(cell(F.col("block"), block(F.col("b"))).alias("cell"), "a", "b")
    return placed, wanted


def _split(fragments: int, parts: int):
    """Each document's n-grams by part: a range of fragments."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cells, doc, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = np.sort(np.frombuffer(raw, np.uint64))
                ends = np.searchsorted(g >> np.uint64(32), [-(-fragments * (k + 1) // parts) for k in range(parts)])
                for k, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    if y > x or k == 0:  # the first part tells the size in any case
                        rows += [(cell, k, doc, size, g[x:y].tobytes()) for cell in cells]
            yield _arrays(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), "cell part doc_id size grams")

    return split


def _overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial overlaps of pairs (right) from segments (left) of one cell and part, whose n-grams are sorted."""
    doc, sizes, raw = left["doc_id"].to_numpy(), left["size"].to_numpy(), left["grams"].combine_chunks().cast(pa.large_binary())
    order = np.argsort(doc)
    at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset) // 8 if len(raw) else np.zeros(1, np.int64)
    n = np.diff(at)
    grams = np.frombuffer(raw.buffers()[2], np.uint64, at[-1]) if at[-1] else np.zeros(0, np.uint64)
    grams, at = grams[at[0] :], at - at[0]
    base = grams.min() if len(grams) else np.uint64(0)
    span = int(grams.max() - base) + 1 if len(grams) else 1
    if span * max(1, len(doc)) < 1 << 64:
        key = grams - base
    else:  # a wide range: numbers of n-grams
        key = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
        span = int(key.max()) + 1
    place = np.arange(len(doc), dtype=np.uint64) * np.uint64(span)
    key += np.repeat(place, n)  # sorted: by row, then n-gram
    a, b = right["a"].to_numpy(), right["b"].to_numpy()
    out, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if len(doc):
        ia, ib = (order[np.minimum(np.searchsorted(doc, x, sorter=order), len(doc) - 1)] for x in (a, b))
        both = np.flatnonzero((doc[ia] == a) & (doc[ib] == b))
        union[both] = sizes[ia[both]] + sizes[ib[both]]
        total = np.cumsum(n[ia[both]])
        for part in np.split(both, np.searchsorted(total, np.arange(STEP_GRAMS, int(total[-1]) if len(total) else 0, STEP_GRAMS))):
            size = n[ia[part]]
            want = key[np.repeat(at[ia[part]], size) + _runs(size)]
            want += np.repeat(place[ib[part]] - place[ia[part]], size)
            where = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[where] == want
            out[part] = np.bincount(np.repeat(np.arange(len(part)), size)[hit], minlength=len(part))
    return pa.Table.from_arrays([right["a"], right["b"], pa.array(union), pa.array(out)], names=["a", "b", "sizes", "overlap"])


def _block_cells(classes: DataFrame, step_grams: int, block: int) -> DataFrame:
    """(component, blocks, cells) of classes (doc_id, component, n), n n-grams each: blocks of a class, and cells that the classes of one block share."""
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("n") / step_grams)).cast("int")
    sizes = stored(sizes.withColumn("blocks", F.least(blocks, F.col("docs").cast("int"))), "class-sizes")
    total = sizes.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    return sizes.select("component", "blocks", F.lit(max(1, -(-total // step_grams))).alias("cells"))


def _products(raw: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The overlaps of each of the documents `left` with each of `right`, numbers in `raw`, where their sorted n-grams are."""
    docs = np.unique(np.concatenate([left, right]))
    n = np.array([len(raw[k]) for k in docs], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *(raw[k] for k in docs)])
    order = np.argsort(grams, kind="stable")
    grams, doc = grams[order], np.repeat(np.arange(len(docs), dtype=np.int32), n)[order]
    del order
    start, df = _lists(grams)
    del grams
    # an n-gram of one document is in no overlap
    kept = df > 1
    doc, df = doc[np.repeat(kept, df)], df[kept]
    width, left, right = len(df), np.searchsorted(docs, left), np.searchsorted(docs, right)
    local = np.repeat(np.arange(width, dtype=np.int32), df)  # sorted; by document within one n-gram
    out = np.zeros((len(left), len(right)), np.float64)
    if not width:
        return out
    df = df.astype(np.float64)
    if len(left) * len(right) * width / 100 <= (df * df).sum() + 100_000:
        step = max(1, 4 * STEP_GRAMS // len(docs))
        for low in range(0, width, step):
            x, y = np.searchsorted(local, [low, low + step])
            dense = np.zeros((len(docs), min(step, width - low)), np.float32)
            dense[doc[x:y], local[x:y] - low] = 1
            for x in range(0, len(left), 256):
                out[x : x + 256] += dense[left[x : x + 256]] @ dense[right].T
        return out
    order = np.argsort(doc, kind="stable")
    doc, local = doc[order], local[order]
    place = np.full(len(docs), -1)
    place[right] = np.arange(len(right))
    there = place[doc] >= 0
    order = np.argsort(local[there], kind="stable")
    held = place[doc[there]][order]
    at = np.searchsorted(local[there][order], np.arange(width + 1))
    ends = np.searchsorted(doc, np.arange(len(docs) + 1))
    for row, k in enumerate(left.tolist()):
        mine = local[ends[k] : ends[k + 1]]
        for part in np.array_split(mine, max(1, int((at[mine + 1] - at[mine]).sum()) // STEP_GRAMS)):
            n = at[part + 1] - at[part]
            out[row] += np.bincount(held[np.repeat(at[part], n) + _runs(n)], minlength=len(right))
    return out


def _within(threshold: float, pairs: bool):
    """Of the classes, or of the two blocks of one, in a cell: the pairs at or above the threshold, or each document's number of them by weight."""

    def count(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        component, doc, size, weight, block, low, high = (table[c].to_numpy() for c in ("component", "doc_id", "size", "weight", "block", "low", "high"))
        raw = [np.sort(np.frombuffer(g, np.uint64)) for g in table["grams"].to_pylist()]
        links = np.zeros(len(doc), np.int64)
        order = np.lexsort((doc, high, low, component))
        start, n = _lists(component[order], low[order], high[order])
        for x, k in zip(start.tolist(), n.tolist(), strict=True):
            at = order[x : x + k]
            alone = low[at[0]] == high[at[0]]
            left, right = (at, at) if alone else (at[block[at] == low[at]], at[block[at] == high[at]])
            if not len(left) or not len(right):
                continue
            overlap = _products(raw, left, right)
            hit = np.zeros(overlap.shape, bool)
            step = max(1, STEP_GRAMS // 4 // len(right))
            for i in range(0, len(left), step):
                part = overlap[i : i + step]
                union = size[left[i : i + step]][:, None] + size[right][None, :] - part
                hit[i : i + step] = (part > 0) & (part >= threshold * union - 1e-9)
            if alone:
                np.fill_diagonal(hit, False)
            if pairs:
                a, b = np.nonzero(np.triu(hit) if alone else hit)
                for i in range(0, len(a), STEP_GRAMS):
                    p, q = a[i : i + STEP_GRAMS], b[i : i + STEP_GRAMS]
                    u, v = doc[left[p]], doc[right[q]]
                    both = overlap[p, q].astype(np.int64)
                    columns = [np.minimum(u, v), np.maximum(u, v), both, size[left[p]] + size[right[q]] - both]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "overlap", "union"])
            else:
                for i in range(0, len(left), step):
                    links[left[i : i + step]] += hit[i : i + step] @ weight[right]
                    if not alone:
                        links[right] += weight[left[i : i + step]] @ hit[i : i + step]
        if not pairs:
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(links)], names=["doc_id", "links"])

    return count


def _counted(sole: DataFrame, nodes: DataFrame, same: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """(a, b, overlap, union) of all pairs of distinct sets within the classes `nodes`, or (doc_id, links), the links of a set's other documents not counted."""
    weights = stored(same.groupBy("first").agg((F.count(F.lit(1)) + 1).alias("weight")), "weights")
    members = sole.join(small(nodes), F.col("doc_id") == F.col("node")).drop("node")
    sizes = _block_cells(members.select("doc_id", "component", F.expr("length(grams) div 8").alias("n")), STEP_GRAMS, BLOCK)
    members = members.join(small(weights), F.col("doc_id") == F.col("first"), "left").join(small(sizes), "component")
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.col("cells"))).otherwise(F.xxhash64("component", low, high))
    placed = members.select(cell.alias("cell"), "component", "doc_id", "size", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"), "block", low.alias("low"), high.alias("high"), "grams")
    schema = "a long, b long, overlap long, union long" if pairs else "doc_id long, links long"
    return placed.groupBy("cell").applyInArrow(trimmed_batches(_within(threshold, pairs)), schema)


def near_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """(doc_id_a, doc_id_b, overlap, jaccard), doc_id_a < doc_id_b, of all pairs of documents at or above the threshold.

    The rows grow as the square of the copies; near_classes has a row for each document.
    """
    near, same = _near_and_same(docs, n, threshold, fragment_grams)
    near = stored(near, "near-sets")
    first = same.select("first").distinct()
    sets = stored(same.select("first", "doc_id").union(first.select("first", F.col("first").alias("doc_id"))), "sets")
    for side in ("doc_id_a", "doc_id_b"):
        members = small(sets).select(F.col("first").alias(side), F.col("doc_id").alias("member"))
        near = near.join(members, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    a, b = F.col("doc_id_a"), F.col("doc_id_b")
    near = near.select(F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b"), "overlap", "jaccard")
    inner = same.select("first", F.col("doc_id").alias("doc_id_b"), "size").join(small(sets).select("first", F.col("doc_id").alias("doc_id_a")), "first").where("doc_id_a < doc_id_b")
    return near.union(inner.select("doc_id_a", "doc_id_b", "size", F.lit(1.0)))


def near_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """As near_pairs, but documents of one set are stood for by the least doc_id, which is paired with each of the others."""
    near, same = _near_and_same(docs, n, threshold, fragment_grams)
    return near.union(same.select("first", "doc_id", F.col("size"), F.lit(1.0)))


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """(doc_id, class_id, links) of every document: the least doc_id that near pairs connect it with, and how many near pairs it is in.

    Copies count each in the links. A document without a partner is a class by itself, with no links.
    """
    text, sole, same, fragments = _sets(docs, n, threshold, fragment_grams)
    nodes = _classes(sole, fragments, threshold)
    links = stored(_counted(sole, nodes, same, threshold, False).groupBy("doc_id").agg(F.sum("links").alias("links")), "links")
    copies = same.groupBy("first").agg(F.count(F.lit(1)).alias("copies"))
    sets = nodes.withColumnRenamed("node", "first").join(copies, "first", "full").join(links.withColumnRenamed("doc_id", "first"), "first", "left")
    none = F.lit(0).cast("long")
    sets = stored(sets.select("first", F.coalesce("component", "first").alias("class_id"), (F.coalesce("copies", none) + F.coalesce("links", none)).alias("links")), "linked-sets")
    others = same.select("doc_id", "first").join(small(sets), "first").select("doc_id", "class_id", "links")
    known = stored(sets.withColumnRenamed("first", "doc_id").union(others), "linked")
    return text.select("doc_id").join(small(known), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", none).alias("links"))


def _near_and_same(docs: DataFrame, n: int, threshold: float, fragment_grams: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct sets, each stood for by its least doc_id, and (doc_id, size, first) of the other documents of a set."""
    _, sole, same, fragments = _sets(docs, n, threshold, fragment_grams)
    near = _counted(sole, _classes(sole, fragments, threshold), same, threshold, True)
    jaccard = F.round(F.col("overlap") / F.col("union"), 6)
    return near.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "overlap", jaccard.alias("jaccard")), same


def _sets(docs: DataFrame, n: int, threshold: float, fragment_grams: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(doc_id, text) of the documents; the distinct sets that can have a partner, each by its least doc_id; (doc_id, size, first) of the other documents of a set; fragments."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    text = _one_row_each(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_column(docs)).alias("text")))
    chars = text.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(1, math.ceil(chars / 6 / fragment_grams))
    segments = text.mapInArrow(trimmed(_segments(fragments, n)), "fragment int, slice long, form int, docs binary, grams binary")
    returned = segments.groupBy("fragment").applyInArrow(trimmed_group(_frequent), "slice long, fragment int, form int, docs binary, grams binary, df binary")
    alive = returned.groupBy("slice").applyInArrow(trimmed_group(_survivors(threshold)), "doc_id long, size long, h1 long, h2 long, ranks binary, grams binary")
    alive = stored(alive, "survivors", TEXT_ROWS)

    sets = alive.where("h1 is not null").groupBy("size", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = alive.where("h1 is not null").select("doc_id", "size", "h1", "h2").join(small(stored(sets, "sets")), ["size", "h1", "h2"]).where("first < doc_id")
    same = stored(same.select("doc_id", "size", "first"), "same-sets")
    sole = alive.join(small(same.select("doc_id")), "doc_id", "left_anti")
    return text, sole, same, fragments


def _classes(sole: DataFrame, fragments: int, threshold: float) -> DataFrame:
    """(node, component) of the sets that have a near one: the least doc_id that near pairs connect them with."""
    buckets = 2 * fragments
    postings = "bucket int, gram long, doc_id long, size long, group long"

    def listed(sets: DataFrame, group: str) -> DataFrame:
        return sets.select("doc_id", "size", F.col(group).alias("group"), "ranks", "grams").mapInArrow(trimmed(_prefixes(buckets)), postings).groupBy("bucket")

    leads = stored(listed(sole, "doc_id").applyInArrow(trimmed_group(_leads(threshold)), "a long, b long").distinct(), "leads", TEXT_ROWS)
    near = stored(_verified(sole, leads, fragments, threshold), "near-leads")
    forget(leads)
    groups = stored(connected_components(near), "groups")
    grouped = sole.join(small(groups), F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    met = listed(grouped, "component").applyInArrow(trimmed_batches(_meetings(buckets, HOT)), postings + ", side byte")
    between = met.groupBy("bucket").applyInArrow(trimmed_batches(_candidates(threshold, HELD_PAIRS)), "a long, b long").distinct()
    between = stored(between, "candidates", TEXT_ROWS)
    more = stored(_verified(sole, between, fragments, threshold), "near-groups")
    forget(between)
    return stored(connected_components(groups.select("node", "component").union(more)), "classes")


def _verified(sole: DataFrame, candidates: DataFrame, fragments: int, threshold: float) -> DataFrame:
    """(a, b) of the candidates at or above the threshold."""
    cells, wanted = _cells(candidates, fragments, CELL_PAIRS)
    placed = sole.join(small(cells), "doc_id").select("cells", "doc_id", "size", "grams")
    placed = placed.mapInArrow(trimmed(_split(fragments, PARTS)), "cell int, part int, doc_id long, size long, grams binary")
    wanted = wanted.select("cell", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "a", "b")
    partial = placed.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(trimmed_group(_overlaps), "a long, b long, sizes long, overlap long")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("sizes").alias("sizes"))
    return summed.where(F.col("overlap") >= threshold * (F.col("sizes") - F.col("overlap")) - 1e-9).select("a", "b")


def _one_row_each(text: DataFrame) -> DataFrame:
    """(doc_id, text) with the distinct texts of a repeated doc_id one after another; the rest isn't shuffled."""
    repeated = stored(text.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return text
    merged = text.join(small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))
    return text.join(small(repeated), "doc_id", "left_anti").unionByName(merged)


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with only the least doc_id of each group that near pairs connect. Rows of null doc_id stay."""
    _, sole, same, fragments = _sets(docs, n, threshold, FRAGMENT_GRAMS)
    node = fresh(docs, "__node")
    # the other documents of a set are never the least of their group
    gone = _classes(sole, fragments, threshold).where("node > component").select(F.col("node").alias(node))
    gone = stored(gone.union(same.select("doc_id")), "near-duplicates")
    return docs.join(small(gone), F.col("doc_id") == F.col(node), "left_anti")


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))) ELSE [array_to_string(w, ' ')] END AS s FROM t WHERE len(w) > 0),
r AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS f FROM g),
x AS (SELECT doc_id, n, unnest(s) AS k FROM r WHERE f = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS m, count(*) AS o FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE o >= {threshold} * (m - o)),
c AS (SELECT doc_id AS node, doc_id AS label FROM r WHERE f = doc_id UNION SELECT b, label FROM c JOIN e ON node = a),
m AS (SELECT node, min(label) AS class_id FROM c GROUP BY node),
v AS (SELECT f, count(*) AS k FROM r GROUP BY f),
l AS (SELECT a AS f, sum(k) AS links FROM e JOIN v ON b = f GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, CAST(coalesce(v.k - 1, 0) + coalesce(links, 0) AS BIGINT) AS links
FROM t LEFT JOIN r ON r.doc_id = t.doc_id LEFT JOIN m ON node = r.f LEFT JOIN v ON v.f = r.f LEFT JOIN l ON l.f = r.f"""

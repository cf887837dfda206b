"""Operator 8: passages that repeat across documents, by a log-structured fingerprint index.

Fingerprints are winnowed: of the hashes of all windows of GRAM words, those that are the least
of some min_words - GRAM + 1 in a row are kept. Two documents that share a run of min_words
words then share a fingerprint of it, wherever the run lies in either.

The index is a folder with a manifest, a list of sorted immutable runs. A run holds the
fingerprints (hash, doc_id, pos, last) of a batch, bucketed and sorted by hash. A new batch is
written as a run; since all runs are bucketed alike, batch and history meet in merge joins
without another shuffle. What they share is verified: around each shared fingerprint, the
windows of min_words words that hold it are hashed whole, in the new documents and in the old
ones that share it; hashes of 47 bits are compared among windows with one fingerprint of 64 bits
at one place. A window that an earlier document has is a repeat, referred to the earliest. So every
repeat is found: all holders of a window have its least fingerprint. Only texts with shared
fingerprints are looked at again, and no two documents are paired, so a passage that thousands of
documents share costs each of them its own windows.

After a batch, runs of one level are compacted, FANOUT of them into one of the next, so each row
is rewritten once a level, and the number of runs grows as the logarithm of the number of batches.
A fingerprint of which all windows are repeats adds nothing to those of the earlier documents and
is left out there: a compacted run holds each passage once, by its earliest holder. The manifest is
replaced when all else is written: a batch that fails leaves the index as it was, and a later
session opens it and goes on.

Defined results: words are as in `words`; within a batch order is by doc_id, and what the index
holds is earlier than any batch; the earliest occurrence stays and is not given; repeats within
one document are not looked for; texts of fewer than min_words words, null and empty ones have
none; rows of null doc_id are left out; rows that repeat a doc_id count as one document, and so does
a doc_id that the index has; an empty batch gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import TEXT_ROWS, arrow_rows, delete, files, forget, scratch_path, small, stored, text_column, trimmed
from citeloom.llm.words import gram_hashes, mix, word_runs

MIN_WORDS = 50
GRAM = 34
BATCHES = 4
FANOUT = 3
#: Fingerprints that one bucket of a run is meant to hold at most; buckets are set when an index is made.
BUCKET_ROWS = 2_000_000
#: The tables of a run: fingerprints, repeats of its documents, and their texts where the index keeps them.
_TABLES = {
    "f": ("hash BIGINT, doc_id BIGINT, pos INT, last INT", "hash"),
    "r": ("doc_id BIGINT, whole ARRAY<STRUCT<a: INT, b: INT>>", "doc_id"),
    "t": ("doc_id BIGINT, text STRING", "doc_id"),
}


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w values in a row."""
    out, have = x, 1
    while 2 * have <= w:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, offsets: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of the grams that are least in some window of w; windows don't cross texts."""
    n = np.diff(offsets)
    if len(grams) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(grams, w, np.minimum)
    text = np.repeat(np.arange(len(n)), n)
    whole = text[: len(least)] == text[w - 1 :]
    # a gram is kept if it equals the greatest of the minima of the windows that hold it
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    kept = np.flatnonzero(_sliding(padded, w, np.maximum) == grams)
    return text[kept], kept - offsets[text[kept]]


def fingerprints(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(hash, doc_id, pos, last) of the winnowed windows of each document; docs has doc_id and lower-cased text.

    last is where the last window of min_words words begins.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, words, offsets, *_ in word_runs(batch.column(1)):
                grams, at = gram_hashes(words, offsets, gram)
                n = np.diff(offsets)
                text, pos = winnow(grams, at, min_words - gram + 1)
                ok = (n >= min_words)[text]
                text, pos = text[ok], pos[ok]
                columns = [grams[at[text] + pos].view(np.int64), ids[i + text], pos.astype(np.int32), (n - min_words)[text].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "doc_id", "pos", "last"])

    return docs.mapInArrow(trimmed(find), "hash long, doc_id long, pos int, last int")


#: Bytes of a window's hash beside the 64 bits of the fingerprint in it.
_BYTES = 6


def _contexts(min_words: int, gram: int):
    """(hash, fresh, doc_id, pos, windows) of the fingerprints of (doc_id, fresh, text, places).

    windows holds, for o from 0 to min_words - gram, the hash of the window that begins o words before the fingerprint; 0 for none.
    """
    slots = min_words - gram + 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, new = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            places = batch.column(3).to_pylist()
            for i, j, words, offsets, *_ in word_runs(batch.column(2)):
                grams, at = gram_hashes(words, offsets, gram)
                windows, first = gram_hashes(words, offsets, min_words)
                long = np.flatnonzero(np.diff(offsets) >= min_words)
                doc = np.repeat(long, [len(places[i + k]) for k in long])
                pos = np.array([p for k in long for p in places[i + k]], np.int64)
                inside = pos + gram <= (offsets[1:] - offsets[:-1])[doc]  # another row of this doc_id may be longer
                doc, pos = doc[inside], pos[inside]
                start = pos[:, None] - np.arange(slots)
                ok = (start >= 0) & (start < (first[1:] - first[:-1])[doc][:, None])
                mine = np.where(ok, windows[np.where(ok, first[doc][:, None] + start, 0)] | np.uint64(1), np.uint64(0)) if len(doc) else np.zeros((0, slots), np.uint64)
                raw = np.ascontiguousarray(mine.astype("<u8")).view(np.uint8).reshape(len(doc), slots, 8)[:, :, :_BYTES]
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((np.arange(len(doc) + 1) * slots * _BYTES).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                columns = [grams[at[doc] + pos].view(np.int64), new[i + doc], ids[i + doc], pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), held], names=["hash", "fresh", "doc_id", "pos", "windows"])

    return expand


def _referred(min_words: int, gram: int):
    """(doc_id, a, b, x, at): windows of a document from a to b that document x has from `at` on, from contexts
    sorted by (hash, fresh, doc_id, pos): the first row with a window is its earliest holder."""
    slots = min_words - gram + 1

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.zeros((n, slots, 8), np.uint8)
            raw[:, :, :_BYTES] = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, slots, _BYTES)
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_numpy(), raw.view("<u8").reshape(n, slots)]
            begun = 0
            if carried is not None and carried[0][-1] == rows[0][0]:
                begun = len(carried[0])
                rows = [np.concatenate(c) for c in zip(carried, rows, strict=True)]
            hashes, fresh, doc, pos, windows = rows
            n = len(hashes)
            key = mix(hashes.view(np.uint64)[:, None] + mix(windows + (np.arange(slots, dtype=np.uint64) << np.uint64(48)))).reshape(-1)
            some = np.flatnonzero(windows.reshape(-1))
            _, first, inverse = np.unique(key[some], return_index=True, return_inverse=True)
            holder = np.full(n * slots, -1, np.int64)
            holder[some] = some[first][inverse] // slots
            # rows that are first with some window speak for the windows of the last hash in the next batch
            last = hashes == hashes[-1]
            last[last] = (holder.reshape(n, slots)[last] == np.flatnonzero(last)[:, None]).any(axis=1)
            last[-1] = True
            carried = [c[last] for c in rows]
            holder = holder.reshape(n, slots)
            hit = (holder >= 0) & fresh[:, None] & (doc[holder] != doc[:, None])
            hit[:begun] = False
            holder = np.where(hit, holder, -1)[:, ::-1]  # in order of where windows begin
            flat = np.concatenate([holder, np.full((n, 1), -1)], axis=1).reshape(-1)
            opens = np.flatnonzero((flat >= 0) & (flat != np.concatenate([[-1], flat[:-1]])))
            closes = np.flatnonzero((flat >= 0) & (flat != np.concatenate([flat[1:], [-1]])))
            row, x = opens // (slots + 1), flat[opens]
            low = pos[row] - (slots - 1) + opens % (slots + 1)
            columns = [doc[row], low.astype(np.int32), (low + closes - opens).astype(np.int32), doc[x], (low - pos[row] + pos[x]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "a", "b", "x", "at"])

    return refer


@dataclass
class FingerprintIndex:
    """An index in a folder; runs are (level, name, whether it keeps texts), oldest first."""

    spark: SparkSession
    path: str
    buckets: int
    min_words: int = MIN_WORDS
    gram: int = GRAM
    fanout: int = FANOUT
    runs: list[tuple[int, str, bool]] = field(default_factory=list)

    @staticmethod
    def create(spark: SparkSession, path: str, documents: int, min_words: int = MIN_WORDS, gram: int = GRAM, fanout: int = FANOUT) -> FingerprintIndex:
        """A new index for batches of about so many documents, at a hundred fingerprints each."""
        if not 0 < gram <= min_words:
            raise ValueError("gram must be from 1 to min_words")
        index = FingerprintIndex(spark, path, max(4, min(-(-documents * 100 // BUCKET_ROWS), 100_000)), min_words, gram, fanout)
        index._save()
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that a folder holds, as its manifest says."""
        store, place = files(spark, f"{path}/manifest.json")
        if not store.exists(place):  # the one before, if a driver was lost while the manifest was replaced
            store, place = files(spark, f"{path}/manifest.old.json")
        stream = store.open(place)
        try:
            known = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        index = FingerprintIndex(spark, path, known["buckets"], known["min_words"], known["gram"], known["fanout"], [tuple(r) for r in known["runs"]])
        for _, name, texts in index.runs:
            for kind in "frt" if texts else "fr":
                columns, key = _TABLES[kind]
                if not spark.catalog.tableExists(f"{name}_{kind}"):
                    spark.sql(f"CREATE TABLE {name}_{kind} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}_{kind}'")
        return index

    def _save(self) -> None:
        text = json.dumps({"buckets": self.buckets, "min_words": self.min_words, "gram": self.gram, "fanout": self.fanout, "runs": self.runs})
        store, place = files(self.spark, f"{self.path}/manifest.json")
        _, old = files(self.spark, f"{self.path}/manifest.old.json")
        _, new = files(self.spark, f"{self.path}/manifest.{uuid.uuid4().hex}.json")
        stream = store.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if store.exists(place):
            store.delete(old, False)
            store.rename(place, old)
        if not store.rename(new, place):
            raise OSError(f"the manifest of {self.path} could not be replaced")

    def _write(self, name: str, kind: str, rows: DataFrame) -> DataFrame:
        table, key = f"{name}_{kind}", _TABLES[kind][1]
        rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{table}").saveAsTable(table)
        return self.spark.table(table)

    def _tables(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(f"{name}_{kind}") for _, name, texts in self.runs if texts or kind != "t"]

    def append(self, docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Takes a batch (doc_id, text) into the index; (doc_id, start_word, end_word, earlier_doc_id, earlier_start) of its repeats.

        The passage of each row begins earlier_start words into the earlier document. `texts` is where texts
        of documents in the index can be read again, if there is such a table; else the index keeps them.
        """
        with arrow_rows(self.spark, TEXT_ROWS):
            return self._append(_keyed(docs), None if texts is None else _keyed(texts))

    def _append(self, docs: DataFrame, texts: DataFrame | None) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        batch = self._write(name, "f", fingerprints(docs, self.min_words, self.gram))

        # fingerprints that documents of the batch share with each other or with history
        ours = batch.groupBy("hash").agg((F.min("doc_id") < F.max("doc_id")).alias("within"))
        met = [run.join(ours.select("hash"), "hash") for run in self._tables("f")]
        if met:
            old = stored(_union(met), "shared-history")
            seen = old.select("hash").distinct().withColumn("met", F.lit(True))
            shared = ours.join(seen, "hash", "left").where("within or met")
        else:
            shared = ours.where("within")
        mine = stored(batch.join(shared.select("hash"), "hash", "left_semi"), "shared-batch")

        # verification: the windows around those fingerprints, in their documents' own words
        contexts = self._around(mine, docs, True)
        if met:
            history = [texts] if texts is not None else self._tables("t")
            contexts = contexts.unionByName(self._around(old, _union(history), False)) if history else contexts
        contexts = contexts.repartition("hash").sortWithinPartitions("hash", "fresh", "doc_id", "pos")
        ranges = contexts.mapInArrow(trimmed(_referred(self.min_words, self.gram)), "doc_id long, a int, b int, x long, at int")
        pieces = stored(self._pieces(ranges), "repeat-pieces")
        self._write(name, "r", pieces.groupBy("doc_id").agg(F.collect_list(F.struct("f.a", "b")).alias("whole")))
        if texts is None:
            self._write(name, "t", docs)
        spans = pieces.groupBy("doc_id", "g").agg(F.min("f").alias("f"), F.max("b").alias("high"))
        found = spans.select("doc_id", F.col("f.a").alias("start_word"), (F.col("high") + self.min_words).alias("end_word"), F.col("f.x").alias("earlier_doc_id"), F.col("f.at").alias("earlier_start"))
        found = stored(found, "repeats")
        forget(mine, pieces, *([old] if met else []))

        self.runs.append((0, name, texts is None))
        stale = self._compact()
        self._save()
        for run in stale:
            self._drop(run)
        return found

    def _around(self, shared: DataFrame, texts: DataFrame, fresh: bool) -> DataFrame:
        """Contexts of the shared fingerprints: only texts of their documents go to Python."""
        places = stored(shared.groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "places")
        wanted = texts.join(small(places), "doc_id").select("doc_id", F.lit(fresh).alias("fresh"), "text", "places")
        return wanted.mapInArrow(trimmed(_contexts(self.min_words, self.gram)), "hash long, fresh boolean, doc_id long, pos int, windows binary")

    def _pieces(self, ranges: DataFrame) -> DataFrame:
        """(doc_id, g, c, f, b): windows one after another, from f.a to b, and the passage g that they belong to.

        Windows that overlap or touch are one passage, referred to the earliest holder of its first window. All of it
        takes one shuffle, by doc_id.
        """
        w = Window.partitionBy("doc_id").orderBy("a", "b", "x", "at")
        one = ranges.repartition("doc_id").withColumn("p", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        one = one.withColumns({"opens": F.when(F.col("a") <= F.col("p") + self.min_words, 0).otherwise(1), "breaks": F.when(F.col("a") <= F.col("p") + 1, 0).otherwise(1)})
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        one = one.withColumns({"g": F.sum("opens").over(w), "c": F.sum("breaks").over(w)})
        return one.groupBy("doc_id", "g", "c").agg(F.min(F.struct("a", "x", "at")).alias("f"), F.max("b").alias("b"))

    def _compact(self) -> list[str]:
        """Merges the last runs while `fanout` of them are of one level; the names of those that are no longer needed."""
        stale: list[str] = []
        while len(self.runs) >= self.fanout and len({level for level, *_ in self.runs[-self.fanout :]}) == 1:
            merged, self.runs = self.runs[-self.fanout :], self.runs[: -self.fanout]
            name, table = f"run_{uuid.uuid4().hex}", lambda run, kind: self.spark.table(f"{run}_{kind}")
            # every window of a fingerprint that goes is one that an earlier document has
            low, high = F.greatest(F.col("pos") - (self.min_words - self.gram), F.lit(0)), F.least("pos", "last")
            inside = F.exists("whole", lambda r: (r["a"] <= low) & (r["b"] >= high))
            repeats = _union([table(run, "r") for _, run, _ in merged]).groupBy("doc_id").agg(F.flatten(F.collect_list("whole")).alias("whole"))
            rows = _union([table(run, "f") for _, run, _ in merged]).join(small(repeats), "doc_id", "left")
            self._write(name, "f", rows.where(F.col("whole").isNull() | ~inside).select("hash", "doc_id", "pos", "last"))
            self._write(name, "r", repeats.limit(0))
            kept = [table(run, "t") for _, run, texts in merged if texts]
            if kept:
                self._write(name, "t", _union(kept))
            self.runs.append((merged[0][0] + 1, name, bool(kept)))
            stale += [run for _, run, _ in merged]
        return stale

    def _drop(self, name: str) -> None:
        for kind in _TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
            delete(self.spark, f"{self.path}/{name}_{kind}")

    def close(self) -> None:
        """Takes the tables out of this session; the folder stays as it is."""
        for _, name, _ in self.runs:
            for kind in _TABLES:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")

    def destroy(self) -> None:
        self.close()
        delete(self.spark, self.path)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_column(docs)).alias("text"))


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, start_word, end_word, earlier_doc_id, earlier_start) of passages that an earlier document has.

    Documents come in `batches` ranges of doc_id, as they would arrive over time, into an index that goes at the end.
    """
    spark, known = docs.sparkSession, docs.where("doc_id is not null")
    # the scale of a batch is known before it is read: from the number of its documents
    cuts = known.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)] or [0.5], 10_000).alias("c"), F.count(F.lit(1)).alias("n")).first()
    bounds = [None, *(sorted(set(cuts["c"] or [])) if batches > 1 else []), None]
    index = FingerprintIndex.create(spark, scratch_path(spark, "fingerprints"), cuts["n"], min_words, gram, fanout)
    found = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        before, part = known, known
        if low is not None:
            before, part = before.where(F.col("doc_id") <= low), part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        found.append(index.append(part, before))
    index.destroy()
    return _union(found)


def oracle(min_words: int = MIN_WORDS) -> str:
    """Runs of windows that an earlier document has, each referred to the earliest document with its first window."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(len(w) - {min_words - 1})) AS i FROM d WHERE len(w) >= {min_words}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {min_words}], ' ')) AS h FROM p),
e AS (SELECT h, min({{'d': doc_id, 'i': i}}) AS e FROM h GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i, e.d AS x, e.i AS xi FROM h JOIN e USING (h) WHERE e.d < doc_id),
g AS (SELECT *, sum(CASE WHEN i <= q + {min_words} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000) AS q FROM r))
SELECT doc_id, CAST(min(i) AS INT) AS start_word, CAST(max(i) + {min_words} AS INT) AS end_word, arg_min(x, i) AS earlier_doc_id, CAST(arg_min(xi, i) AS INT) AS earlier_start FROM g GROUP BY doc_id, g"""

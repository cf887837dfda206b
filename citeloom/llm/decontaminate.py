"""Operator 1: benchmark decontamination by BM25 with block-max WAND.

The test items are the indexed collection and every passage of every document is a query: its
distinct words. Items are classed by length: an item of up to half passage_words is looked for in
passages of passage_words, one twice as long in passages twice as long, and so on. Passages are
windows that overlap the next by half, so an item that occurs in a document lies whole within some
passage of its class, and no item changes the passages that others are looked for in.

Scores are BM25 in shares of the item's score against itself, so that one threshold holds for
items of any length, and all items at or above it are wanted. Document frequencies, the number
of items and their mean length are those of the whole test set, whatever parts it is searched in.
Postings are cut into blocks of item numbers, alike for all terms, each with its greatest impact.
The terms of a passage are put in order of their greatest impact: those before the pivot, where
the sum of these reaches the threshold, can't lift an item there by themselves, so only postings
from the pivot on are opened. A block stays open while its maxima and the bounds before the
pivot reach the threshold; then the maxima before the pivot are looked up for open blocks
only, and what still passes is scored exactly. This runs over many passages at once.

Retrieved pairs are verified: of the question's word n-grams and of the answer's, a share each
must occur in the passage. Words and n-grams are compared by 64-bit hashes. Items are plain texts,
so the answer is the last sentence, or the last quarter of the words of a text of one sentence,
and the question is the rest.

Documents are scanned once, without a shuffle. The index is sent to the tasks in parts of at
most part_words words of items; where items exceed that, the scan is repeated for each part, with
equal results. The driver holds one part at a time.

Defined results: null and empty texts and items match nothing; rows of null item_id are no items;
rows that repeat an item_id with other texts are items of their own, each with its rows; each row
of a document gives its own matches; a null doc_id is carried as null; texts of any length are
taken whole; other columns are ignored; no documents or no items give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import stored, text_column, trim, trimmed
from citeloom.llm.words import gram_hashes, word_runs

THRESHOLD = 0.5
OVERLAP = 0.6
GRAM = 3
PASSAGE_WORDS = 128
BLOCK_ITEMS = 4
#: Words of items in one part: at some 40 bytes a word an index of about 32 MB in each task.
PART_WORDS = 800_000
K1, B = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FIELDS = "doc_id long, item_id long, passage_no int, score double, question_overlap double, answer_overlap double"


def _hashes(texts: list[str]) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for _, _, words, offsets, *_ in word_runs(pa.array(texts, pa.string())):
        found += [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return found


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of both parts of an item."""
    parts = [w for w in _hashes([p.lower() for p in _SENTENCE.split(text)]) if len(w)]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    words = parts[0] if parts else np.zeros(0, np.uint64)
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    return np.unique(gram_hashes(words, np.array([0, len(words)]), n)[0]) if n else words[:0]


def overlap(part: np.ndarray, passage: np.ndarray, n: int) -> float:
    """The share of the part's word n-grams that the passage has; an empty part is wholly there."""
    n = min(n, len(part))
    if n == 0:
        return 1.0
    if len(passage) < n:
        return 0.0
    return float(np.isin(_grams(part, n), _grams(passage, n)).mean())


def passage_size(words: int, passage_words: int) -> int:
    """The words of a passage for items of so many words."""
    size = passage_words
    while size < 2 * words:
        size *= 2
    return size


@dataclass
class Statistics:
    """Of the whole test set: items, their mean length, and in how many each word is."""

    items: int
    mean: float
    words: np.ndarray  # sorted hashes of the words of a part at least
    df: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        own = [h for h in _hashes([t.lower() for t in texts]) if len(h)]
        words, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, own)]), return_counts=True)
        return Statistics(len(own), float(np.mean([len(h) for h in own])) if own else 1.0, words, df)


@dataclass
class Index:
    """Items of one passage size by number; postings in the order of items; block maxima by term."""

    stride: int  # half the words of a passage
    ids: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray  # sorted word hashes
    top: np.ndarray  # the greatest impact of each term
    item_at: np.ndarray  # postings of item i: item_at[i] to item_at[i + 1]
    item_term: np.ndarray
    item_weight: np.ndarray
    block_at: np.ndarray  # blocks of term t: block_at[t] to block_at[t + 1]
    block_no: np.ndarray
    block_max: np.ndarray
    blocks: int
    block_items: int

    @staticmethod
    def build(items: list[tuple[int, str]], known: Statistics, size: int, block_items: int = BLOCK_ITEMS) -> Index:
        parts = [question_and_answer(text) for _, text in items]
        words = [np.concatenate(p) for p in parts]
        own = [np.unique(w, return_counts=True) for w in words]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in own)]))
        at = np.concatenate([[0], np.cumsum([len(t) for t, _ in own])]).astype(np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(terms, t) for t, _ in own)]).astype(np.int64)
        tf = np.concatenate([np.zeros(0), *(c for _, c in own)])
        item = np.repeat(np.arange(len(items)), np.diff(at))
        df = known.df[np.searchsorted(known.words, terms)]
        idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
        length = np.array([len(w) for w in words], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / known.mean))
        weight = weight / np.bincount(item, weight, minlength=len(items))[item]
        blocks = max(1, -(-len(items) // block_items))
        pair = term * blocks + item // block_items
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        most = np.maximum.reduceat(weight[order], first)
        block_at = np.concatenate([[0], np.cumsum(np.bincount(pair[first] // blocks, minlength=len(terms)))])
        top = np.maximum.reduceat(most, block_at[:-1])
        ids = np.array([i for i, _ in items], np.int64)
        return Index(-(-size // 2), ids, parts, terms, top, at, term, weight, block_at, pair[first] % blocks, most, blocks, block_items)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for those that no item has."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs at or above the threshold, from the distinct (passage, term) pairs in order, of n passages."""
        least = threshold - 1e-9
        order = np.lexsort((self.top[term], passage))
        p, t = passage[order], term[order]
        bound = self.top[t]
        total = np.cumsum(bound)
        first = np.searchsorted(p, np.arange(n))
        begun = np.concatenate([[0.0], total])[first]
        late = total - begun[p] >= least  # from the pivot on
        before = np.bincount(p[~late], bound[~late], minlength=n)
        size = self.block_at[t[late] + 1] - self.block_at[t[late]]
        posting = _spread(self.block_at[t[late]], size)
        cell = np.repeat(p[late], size) * self.blocks + self.block_no[posting]
        if n * self.blocks <= 1 << 22:
            sums = np.bincount(cell, self.block_max[posting], minlength=n * self.blocks)
            cells = np.flatnonzero(sums)
            sums = sums[cells]
        else:
            cells, inverse = np.unique(cell, return_inverse=True)
            sums = np.bincount(inverse, self.block_max[posting])
        open_ = sums + before[cells // self.blocks] >= least
        cells, sums = cells[open_], sums[open_]
        # the maxima before the pivot, for the blocks that are still open
        early, et = p[~late], t[~late]
        low, high = np.searchsorted(early, cells // self.blocks), np.searchsorted(early, cells // self.blocks, side="right")
        whose = np.repeat(np.arange(len(cells)), high - low)
        et = et[_spread(low, high - low)]
        key = np.repeat(np.arange(len(self.terms)), np.diff(self.block_at)) * self.blocks + self.block_no if len(et) else np.zeros(1, np.int64)
        want = et * self.blocks + cells[whose] % self.blocks
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want if len(et) else np.zeros(0, bool)
        sums = sums + np.bincount(whose[hit], self.block_max[at[hit]], minlength=len(cells))
        cells = cells[sums >= least]
        p = np.repeat(cells // self.blocks, self.block_items)
        i = ((cells % self.blocks * self.block_items)[:, None] + np.arange(self.block_items)).reshape(-1)
        p, i = p[i < len(self.ids)], i[i < len(self.ids)]
        # the exact score: which of the item's terms the passage has
        size = self.item_at[i + 1] - self.item_at[i]
        posting = _spread(self.item_at[i], size)
        have = passage * len(self.terms) + term
        want = np.repeat(p, size) * len(self.terms) + self.item_term[posting]
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        hit = have[at] == want
        score = np.bincount(np.repeat(np.arange(len(i)), size)[hit], self.item_weight[posting][hit], minlength=len(i))
        ok = score >= least
        return p[ok], i[ok], score[ok]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... for size[k] places, for each k."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _matches(column: pa.Array, indexes: list[Index], threshold: float, share: float, gram: int) -> Iterator[tuple[int, Index, int, int, float, float, float]]:
    """(row, index, item number, passage, score, overlaps) for a column of lower-cased texts: the best passage of each."""
    for first, last, words, offsets, *_ in word_runs(column):
        n = np.diff(offsets)
        for index in indexes:
            stride = index.stride
            # passage k of a text is its stretches k and k + 1; the last stretch alone is no passage but in a text of one
            stretches = -(-n // stride)
            passages = np.maximum(stretches - 1, (n > 0).astype(np.int64))
            base = np.concatenate([[0], np.cumsum(passages)])
            term = index.place(words)
            known = np.flatnonzero(term >= 0)
            if not len(known):
                continue
            row = np.repeat(np.arange(last - first), n)[known]
            stretch = (known - offsets[row]) // stride
            key = np.concatenate([base[row] + stretch, base[row] + stretch - 1])
            ok = np.concatenate([stretch < passages[row], stretch > 0])
            pairs = np.unique((key * len(index.terms) + np.concatenate([term[known]] * 2))[ok])
            p, i, score = index.retrieve(pairs // len(index.terms), pairs % len(index.terms), int(base[-1]), threshold)
            best: dict[tuple[int, int], tuple] = {}
            rows = np.searchsorted(base, p, side="right") - 1
            for k, item, s, r in zip(p.tolist(), i.tolist(), score.tolist(), rows.tolist(), strict=True):
                no = k - int(base[r])
                text = words[offsets[r] + no * stride : min(offsets[r + 1], offsets[r] + (no + 2) * stride)]
                q, a = (overlap(part, text, gram) for part in index.parts[item])
                if q >= share and a >= share:
                    found = (round(s, 6), round(q, 6), round(a, 6), -no)
                    best[r, item] = max(best.get((r, item), found), found)
            for (r, item), (s, q, a, no) in best.items():
                yield first + r, index, item, -no, s, q, a


def _index_parts(items: DataFrame, passage_words: int, part_words: int) -> Iterator[list[Index]]:
    """Indexes of the items, by passage size, for one part of at most part_words words after another."""
    text = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_column(items).alias("text")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _hashes([t.lower() for t in batch.column(1).to_pylist()])
            sizes = [passage_size(len(h), passage_words) for h in own]
            columns = [*batch.columns, pa.array([len(h) for h in own], pa.int64()), pa.array(sizes, pa.int64()), pa.array([np.unique(h).view(np.int64) for h in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "n", "size", "words"])

    held = stored(text.mapInArrow(measure, "item_id long, text string, n long, size long, words array<long>").where("n > 0"), "items")
    whole = held.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
    if not whole["items"]:
        return
    df = stored(held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "item-words")
    # the window is over numbers of items, not their texts
    begun = F.sum("n").over(Window.orderBy("size", "item_id", "h").rowsBetween(Window.unboundedPreceding, -1))
    placed = held.select("item_id", "size", "n", F.xxhash64("text").alias("h")).withColumn("part", F.floor(F.coalesce(begun, F.lit(0)) / part_words))
    placed = stored(placed.select("item_id", "h", "part"), "item-parts")
    for (part,) in placed.select("part").distinct().orderBy("part").collect():
        mine = held.withColumn("h", F.xxhash64("text")).join(placed.where(F.col("part") == part), ["item_id", "h"])
        rows = sorted((r["size"], r["item_id"], r["text"]) for r in mine.select("size", "item_id", "text").collect())
        words = df.join(mine.select(F.explode("words").alias("word")).distinct(), "word").toArrow()
        hashes, counts = words["word"].to_numpy().view(np.uint64), words["df"].to_numpy()
        order = np.argsort(hashes)
        known = Statistics(whole["items"], whole["mean"], hashes[order], counts[order])
        yield [Index.build([r[1:] for r in rows if r[0] == size], known, size) for size in sorted({r[0] for r in rows})]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_no", pa.int32()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    share: float = OVERLAP,
    gram: int = GRAM,
    passage_words: int = PASSAGE_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """(doc_id, item_id, passage_no, score, question_overlap, answer_overlap) of each item that a document holds.

    Of several passages of a document the one of highest score is given, then of most overlap, then the
    first; passage_no counts passages of the item's class from 0.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_column(docs)).alias("text"))
    found: list[DataFrame] = []
    for indexes in _index_parts(items, passage_words, part_words):

        def search(batches: Iterator[pa.RecordBatch], indexes: list[Index] = indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_matches(batch.column(1), indexes, threshold, share, gram))
                rows, index, item, *rest = zip(*hits, strict=True) if hits else [()] * 7
                ids = [int(x.ids[i]) for x, i in zip(index, item, strict=True)]
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, f.type) for c, f in zip(rest, list(_SCHEMA)[2:], strict=True))], schema=_SCHEMA)

        if found:  # one index at a time is kept by a plan
            found[-1] = stored(found[-1], "contaminated")
        found.append(text.mapInArrow(trimmed(search), _FIELDS))
    if not found:
        return docs.sparkSession.createDataFrame([], _FIELDS)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    share: float = OVERLAP,
    gram: int = GRAM,
    passage_words: int = PASSAGE_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """`docs`, all columns, without the rows in which any item is found."""
    out = docs
    for number, indexes in enumerate(_index_parts(items, passage_words, part_words)):
        if number:
            out = stored(out, "clean")
        # only the texts go to Python, and only whether they hold an item comes back
        out = out.where(~F.arrow_udf(_holds(indexes, threshold, share, gram), "boolean")(F.lower(text_column(out))))
    return out


def _holds(indexes: list[Index], threshold: float, share: float, gram: int) -> Callable:
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            hit[[r for r, *_ in _matches(texts, indexes, threshold, share, gram)]] = True
            yield pa.array(hit)
        trim()

    return holds


def oracle() -> str:
    """Exhaustive BM25 and overlaps in SQL, with the default parameters."""
    words = lambda x: f"list_filter(string_split_regex(lower({x}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    grams = lambda w, n: f"list_distinct(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i : i + {n} - 1], ' ')))"
    share = lambda part: f"CASE WHEN len({part}) = 0 THEN 1.0 WHEN len(pw) < least({GRAM}, len({part})) THEN 0.0 ELSE len(list_intersect({grams(part, f'least({GRAM}, len({part}))')}, {grams('pw', f'least({GRAM}, len({part}))')})) / len({grams(part, f'least({GRAM}, len({part}))')}) END"
    return f"""
WITH it AS (SELECT DISTINCT item_id, coalesce(text, '') AS t FROM benchmark WHERE item_id IS NOT NULL),
sp AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {words("s")}), lambda x: len(x) > 0) AS ss, row_number() OVER (ORDER BY item_id, t) AS k FROM it),
pa AS (SELECT item_id, k, CASE WHEN len(ss) > 1 THEN flatten(ss[1 : len(ss) - 1]) WHEN len(ss[1]) > 1 THEN ss[1][1 : len(ss[1]) - greatest(1, len(ss[1]) // 4)] ELSE ss[1] END AS q,
  CASE WHEN len(ss) > 1 THEN ss[len(ss)] WHEN len(ss[1]) > 1 THEN ss[1][len(ss[1]) - greatest(1, len(ss[1]) // 4) + 1 :] ELSE []::VARCHAR[] END AS a FROM sp WHERE len(ss) > 0),
wd AS (SELECT k, w, count(*) AS tf FROM (SELECT k, unnest(list_concat(q, a)) AS w FROM pa) GROUP BY ALL),
ln AS (SELECT k, sum(tf) AS l FROM wd GROUP BY k),
c AS (SELECT count(*) AS n, avg(l) AS m FROM ln),
z AS (SELECT k, CAST({PASSAGE_WORDS} / 2 * 2 ** greatest(0, ceil(log2(2 * l / {PASSAGE_WORDS}))) AS BIGINT) AS stride FROM ln),
df AS (SELECT w, count(*) AS df FROM wd GROUP BY w),
wt AS (SELECT k, w, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * l / m)) AS x FROM wd JOIN df USING (w) JOIN ln USING (k), c),
im AS (SELECT k, w, x / sum(x) OVER (PARTITION BY k) AS x FROM wt),
d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, stride, unnest(range(greatest(CAST(ceil(len(w) / stride) AS BIGINT) - 1, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS no FROM d, (SELECT DISTINCT stride FROM z)),
ps AS (SELECT doc_id, no, stride, w[CAST(no * stride + 1 AS BIGINT) : CAST((no + 2) * stride AS BIGINT)] AS pw FROM p),
u AS (SELECT doc_id, no, stride, unnest(list_distinct(pw)) AS w FROM ps),
s AS (SELECT doc_id, no, u.stride, k, sum(x) AS score FROM u JOIN im USING (w) JOIN z USING (k) WHERE u.stride = z.stride GROUP BY ALL HAVING sum(x) >= {THRESHOLD} - 1e-9),
o AS (SELECT doc_id, item_id, no, round(score, 6) AS score, round({share("q")}, 6) AS qo, round({share("a")}, 6) AS ao FROM s JOIN ps USING (doc_id, no, stride) JOIN pa USING (k))
SELECT doc_id, item_id, CAST(no AS INT) AS passage_no, score, qo AS question_overlap, ao AS answer_overlap FROM o WHERE qo >= {OVERLAP} AND ao >= {OVERLAP}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, qo DESC, ao DESC, no) = 1"""

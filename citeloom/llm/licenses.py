"""Operator 4: licence scans by Dice coefficient over word bigrams.

Units of comparison are every line, every paragraph of several lines (runs between lines
that hold no word), the whole document if several paragraphs hold words, and spans of neighbouring
paragraphs, since long licences are laid out in several. Texts are lower-cased and reduced to
their words (see `words`); a unit's distinct word bigrams are compared to those of each template:
Dice = 2 |A & B| / (|A| + |B|). Of the spans of a document the best is given for each licence:
of most Dice, then of fewest paragraphs, then the first. Spans are compared with
templates of SPAN_BIGRAMS or more, and aren't one paragraph or all of the document.

Size bounds prune. Templates are in order of size, and only those from t/(2-t) to (2-t)/t times the
bigrams of a unit, a slice, are intersected. Since |A & B| is |B| at most, a unit can only match
if a share t/(2-t) of its own bigrams occur in templates at all, which takes one look-up per
bigram; and a span can only match a template if the whole document has that share of the
template's, so that hardly any unit is compared in full.

Everything is local to a row: one scan, no shuffle, and the templates are a constant of
the program.

Defined results: a null or empty text has no units and gives no row; a unit of fewer than
two words has no bigram and gives no row; ties between templates go to the lower template
number; repeated rows of the input each give their rows, and a null doc_id is carried as null;
texts of any length are compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import text_column, trimmed
from citeloom.llm.license_templates import TEMPLATES
from citeloom.llm.words import BASE, chunks, mix, text_bytes, word_runs

THRESHOLD = 0.8
SPAN_BIGRAMS = 40
_NIL = 1e-9  # what rounding may take from a bound that is met exactly
_FIELDS = "doc_id long, unit string, unit_no int, last_no int, license string, template_no int, shared int, dice double"


def _pairs(units: np.ndarray, grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The distinct (unit, bigram, whether known)."""
    order = np.lexsort((grams, units))
    u, g, k = units[order].astype(np.uint64), grams[order], known[order].astype(np.uint64)
    first = np.concatenate([[True], (u[1:] != u[:-1]) | (g[1:] != g[:-1])])
    return np.stack([u[first], g[first], k[first]])


def _bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(BASE) + words[1:] * np.uint64(pow(BASE, 2, 1 << 64)))


class _Templates:
    """Templates in order of size; `number` is that of the list they come from."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        sets = []
        for _, text in templates:
            w = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, *_ in word_runs(pa.array([text.lower()])))])
            sets.append(np.unique(_bigrams(w)) if len(w) > 1 else np.zeros(0, np.uint64))
        self.t, self.share = threshold, threshold / (2 - threshold)
        sizes = np.array([len(s) for s in sets], np.int64)
        self.number = np.argsort(sizes, kind="stable")
        self.number = self.number[sizes[self.number] > 0]
        self.sizes = sizes[self.number]
        self.names = [templates[k][0] for k in self.number]
        self.known = np.unique(np.concatenate([np.zeros(1, np.uint64), *sets]))
        self.within = np.stack([np.isin(self.known, sets[k]) for k in self.number]) if len(self.number) else np.zeros((0, 1), bool)
        self.fewest = int(np.ceil(self.share * self.sizes[0] - _NIL)) if len(self.sizes) else 1 << 60
        self.long = int(np.searchsorted(self.sizes, SPAN_BIGRAMS))

    def place(self, grams: np.ndarray) -> np.ndarray:
        """Index in `known`, or -1."""
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, at, -1)

    def _slice(self, size: int) -> tuple[int, int]:
        """The templates whose sizes can reach the threshold with a unit of so many bigrams."""
        low = np.searchsorted(self.sizes * (2 - self.t), size * self.t - _NIL)
        return int(low), int(np.searchsorted(self.sizes * self.t, size * (2 - self.t) + _NIL, side="right"))

    def best(self, grams: np.ndarray, places: np.ndarray) -> tuple[str, int, int, float] | None:
        hits = np.unique(places[places >= 0])
        # a lower bound of the distinct bigrams refutes most long units before they are sorted
        if len(hits) < self.share * len(np.unique(grams[:64])) - _NIL:
            return None
        na = len(np.unique(grams))
        low, high = self._slice(na)
        if len(hits) < self.share * na - _NIL or low >= high:
            return None
        shared = self.within[low:high, hits].sum(axis=1)
        total = na + self.sizes[low:high]
        dice = np.where(2 * shared >= self.t * total - _NIL, np.round(2 * shared / total, 6), -1)
        k = int(np.lexsort((self.number[low:high], -dice))[0])
        return (self.names[low + k], int(self.number[low + k]), int(shared[k]), float(dice[k])) if dice[k] >= 0 else None

    def spans(self, grams: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, str, int, int, float]]:
        """(first, last paragraph, license, template_no, shared, dice) of the best span for each licence; paragraph k holds words
        starts[k] to ends[k], and bigram i is of words i and i + 1."""
        hits = np.unique(places[places >= 0])
        near = self.within[self.long :, hits].sum(axis=1) >= self.share * self.sizes[self.long :] - _NIL
        best: dict[str, tuple] = {}
        for k in (np.flatnonzero(near) + self.long).tolist():
            mine = (places >= 0) & self.within[k, np.maximum(places, 0)]
            total = np.concatenate([[0], np.cumsum(mine)])
            upto = total[ends - 1]
            enough = np.searchsorted(upto, total[starts] + self.share * self.sizes[k] - _NIL)
            for i in range(len(starts)):
                for j in range(max(i + 1, int(enough[i])), len(starts)):
                    if j - i == len(starts) - 1:
                        continue
                    a = len(np.unique(grams[starts[i] : ends[j] - 1]))
                    if a * self.t > self.sizes[k] * (2 - self.t) + _NIL:
                        break
                    part = places[starts[i] : ends[j] - 1]
                    shared = int(self.within[k, np.unique(part[part >= 0])].sum())
                    if 2 * shared >= self.t * (a + self.sizes[k]) - _NIL:
                        dice = round(2 * shared / (a + int(self.sizes[k])), 6)
                        found = (dice, i - j, -i, -int(self.number[k]), shared)
                        best[self.names[k]] = max(best.get(self.names[k], found), found)
        for name, (dice, length, first, number, shared) in best.items():
            yield -first, -first - length, name, -number, shared, dice


def _scan(column: pa.Array, known: _Templates) -> Iterator[tuple[int, str, int, int, str, int, int, float]]:
    """(row, unit, unit_no, last_no, license, template_no, shared, dice) for a column of lower-cased texts."""
    data, at = text_bytes(column)
    for (first, last), (_, _, words, offsets, start, _) in zip(chunks(at), word_runs(column), strict=True):
        if len(words) < 2:
            continue
        raw, ends = data[at[first] : at[last]], at[first + 1 : last + 1] - at[first]
        doc = np.repeat(np.arange(last - first), np.diff(offsets))
        breaks = np.flatnonzero(raw == 10)
        break_doc = np.searchsorted(ends, breaks, side="right")
        # lines are numbered over the whole run: each text has one more than its line breaks
        per_doc = 1 + np.bincount(break_doc, minlength=last - first)
        head = np.concatenate([[0], np.cumsum(per_doc)])
        line = np.searchsorted(breaks, start) + doc
        filled = np.bincount(line, minlength=head[-1])
        inner = np.ones(head[-1], bool)
        inner[head[:-1]] = inner[head[1:] - 1] = False
        blank = inner & (filled == 0)
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        paragraph = np.cumsum(opens) + np.repeat(np.arange(last - first), per_doc)
        places = known.place(grams := _bigrams(words))
        for unit, of_word, number in (
            ("line", line, lambda w: line[w] - head[doc[w]]),
            ("paragraph", paragraph[line], lambda w: paragraph[line[w]] - paragraph[head[doc[w]]]),
            ("document", doc, lambda w: 0),
        ):
            # of the bigrams that lie within one unit, those that any template has
            hits = np.flatnonzero((places >= 0) & (of_word[:-1] == of_word[1:]))
            if not len(hits):
                continue
            units, counts = np.unique(of_word[hits], return_counts=True)
            units = units[counts >= known.fewest]
            if unit == "line" and len(units):
                # lines are many: their distinct bigrams and known ones are counted all at once
                some = np.flatnonzero(np.isin(of_word[:-1], units) & (of_word[:-1] == of_word[1:]))
                pair = _pairs(of_word[some], grams[some], places[some] >= 0)
                whole, good = np.bincount(pair[0].astype(np.int64)), np.bincount(pair[0].astype(np.int64), pair[2].astype(float))
                units = units[good[units] >= known.share * whole[units] - _NIL]
            low, high = np.searchsorted(of_word, units), np.searchsorted(of_word, units, side="right")
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                if unit == "paragraph" and line[a] == line[b - 1] or unit == "document" and paragraph[line[a]] == paragraph[line[b - 1]]:
                    continue
                found = known.best(grams[a : b - 1], places[a : b - 1])
                if found:
                    yield first + int(doc[a]), unit, int(number(a)), int(number(a)), *found
                if unit == "document":
                    mine = paragraph[line[a:b]]
                    begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    numbers = mine[begins] - paragraph[head[doc[a]]]
                    for i, j, *rest in known.spans(grams[a : b - 1], places[a : b - 1], begins, np.append(begins[1:], b - a)):
                        yield first + int(doc[a]), "span", int(numbers[i]), int(numbers[j]), *rest


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, unit, unit_no, last_no, license, template_no, shared, dice) for each unit that matches a template.

    unit is 'line', 'paragraph', 'span' or 'document'; unit_no counts lines or paragraphs from 0, and last_no is that of
    the last paragraph of a span. Of a unit's templates that reach the threshold, the one of highest Dice is given.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("unit", pa.string()), ("unit_no", pa.int32()), ("last_no", pa.int32()), ("license", pa.string()), ("template_no", pa.int32()), ("shared", pa.int32()), ("dice", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(templates, threshold)
        for batch in batches:
            found = list(_scan(batch.column(1), known))
            rows, *rest = zip(*found, strict=True) if found else [()] * 8
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_column(docs)).alias("text")).mapInArrow(trimmed(scan), _FIELDS)


def oracle(threshold: float = THRESHOLD) -> str:
    word = "0-9a-z\\x{80}-\\x{10FFFF}"
    words = lambda x: f"list_filter(string_split_regex(lower({x}), '[^{word}]+'), lambda x: x <> '')"
    bigrams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH tw AS (SELECT k AS template_no, name AS license, {words("body")} AS w FROM (VALUES {values}) v(k, name, body)),
tb AS (SELECT template_no, license, {bigrams("w")} AS b FROM tw),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, string_split_regex(t, '\\n([^{word}\\n]*\\n)+') AS ps FROM d),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(ls))) AS unit_no, unnest(ls) AS body FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) AS body FROM p) WHERE regexp_matches(body, '[{word}][^\\n]*\\n(.|\\n)*[{word}]')
  UNION ALL SELECT doc_id, 'document', 0, t FROM p WHERE len(list_filter(ps, lambda x: regexp_matches(x, '[{word}]'))) > 1),
uw AS (SELECT doc_id, unit, unit_no, {words("body")} AS w FROM u),
ub AS (SELECT doc_id, unit, unit_no, {bigrams("w")} AS a FROM uw WHERE len(w) > 1),
s AS (SELECT doc_id, unit, unit_no, license, template_no, len(list_intersect(a, b)) AS shared, len(a) + len(b) AS n
      FROM ub JOIN tb ON len(a) * {2 - threshold} >= len(b) * {threshold} AND len(b) * {2 - threshold} >= len(a) * {threshold}),
r AS (SELECT *, round(2 * shared / n, 6) AS dice FROM s WHERE 2 * shared >= {threshold} * n),
dw AS (SELECT doc_id, {words("t")} AS w FROM d),
da AS (SELECT doc_id, unnest(a) AS g FROM (SELECT doc_id, {bigrams("w")} AS a FROM dw)),
tg AS (SELECT template_no, len(b) AS n, unnest(b) AS g FROM tb WHERE len(b) >= {SPAN_BIGRAMS}),
lh AS (SELECT doc_id, template_no FROM da JOIN tg USING (g) GROUP BY doc_id, template_no, n HAVING count(*) >= {threshold / (2 - threshold)} * n - 1e-9),
lt AS (SELECT doc_id, w, template_no, license, b FROM lh JOIN dw USING (doc_id) JOIN tb USING (template_no)),
pn AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, len({words("body")}) AS n FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS body FROM p WHERE doc_id IN (SELECT doc_id FROM lt))) WHERE n > 0),
sl AS (SELECT lt.doc_id, x.i, y.i AS j, y.k - x.k AS gap, template_no, license, b, w[CAST(x.e - x.n + 1 AS BIGINT) : CAST(y.e AS BIGINT)] AS w FROM lt JOIN pn x ON x.doc_id = lt.doc_id JOIN pn y ON y.doc_id = lt.doc_id AND y.k > x.k AND y.k - x.k < x.c - 1),
sw AS (SELECT * EXCLUDE (w), {bigrams("w")} AS a FROM sl),
sp AS (SELECT doc_id, i, j, gap, template_no, license, len(list_intersect(a, b)) AS shared, len(a) + len(b) AS n FROM sw),
sb AS (SELECT *, round(2 * shared / n, 6) AS dice FROM sp WHERE 2 * shared >= {threshold} * n QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY round(2 * shared / n, 6) DESC, gap, i, template_no) = 1)
SELECT doc_id, 'span' AS unit, CAST(i AS INT) AS unit_no, CAST(j AS INT) AS last_no, license, CAST(template_no AS INT) AS template_no, CAST(shared AS INT) AS shared, dice FROM sb UNION ALL
SELECT doc_id, unit, CAST(unit_no AS INT) AS unit_no, CAST(unit_no AS INT) AS last_no, license, CAST(template_no AS INT) AS template_no, CAST(shared AS INT) AS shared, dice
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, template_no) = 1"""

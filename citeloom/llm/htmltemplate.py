"""Operator 5: extraction from HTML by equivalence classes of template tokens.

A token is a tag (its name, its class and id, and the names of its other attributes), a comment,
or a word; its role is the token with the path of tags it stands in. Roles that occur equally
often on every page of a host share an occurrence vector and form an equivalence class; classes
of enough roles and support are those a template prints together. A class is valid if each of
its occurrences has its roles in one order, on all pages, and if it nests: its occurrences never
cross those of another class and always lie in the same gap of the same class around them. The
valid classes, nested, are the template; what lies between template tokens are the slots.

Support counts pages: a layout on min_support of a host's pages, one in twenty, and on two pages at
least, is found, so several layouts of one host each have their classes; but a class never crosses
another, so labels of one layout between tokens that all layouts share remain slot text.

Spark does this without ever holding a host: occurrence vectors are compared by sums of hashes
of (page, count), which combine map-side. First pages are brought together by host, large hosts
in shares of SALT_PAGES. Roles that a task finds on fewer than min_support of the host's pages in
it needn't leave it: a role that frequent overall is that frequent in some share, so the
union of what tasks find misses none; a second scan counts exactly those. Pages are then
reduced to the sequence of their class tokens, a small table, on which classes are validated in
rounds until none fails. A last scan extracts.

A path of tags is known by a 64-bit hash made of its parent's and a name, so it costs the same at any
depth, and markup is cut in one pass, whatever is left unclosed. The roles of all hosts go to the
tasks by broadcast only while their bytes are few; else pages meet them in a co-group by host and salt.

Defined results: a page on a host of fewer than MIN_PAGES pages, or of no template, is one slot;
class 0 is that of no class. A null html has no slots, a null url the host ''; rows of null
page_id are left out; rows that repeat a page_id are pages each; an empty table gives no rows. Slots
without text give no row. Contents of script and style are not text; a comment, script or tag that
nothing closes is text. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import BROADCAST_BYTES, TEXT_ROWS, small, stored, table_bytes, trimmed

MIN_PAGES = 3
MIN_SUPPORT = 0.05
MIN_ROLES = 3
SALT_PAGES = 5000
#: Bytes of pages that one task of the first scan is meant to have.
TASK_BYTES = 16 << 20
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"
_TAG = re.compile(r"<(?:!--|(script|style)\b[^>]*>|[A-Za-z/!?][^>]*>)", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_NAME = re.compile(r"</?\s*([A-Za-z0-9:-]+)")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"(\s+)")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "article", "section", "footer", "header", "nav", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "main", "aside", "form"}


def pieces(page: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, '' or script or style) of comments, scripts and styles with their contents, and tags, in one pass.

    What could only be closed by something that the rest of the page doesn't have is passed over.
    """
    at, last, comment = 0, page.rfind(">") + 1, page.rfind("-->")
    ends: dict[str, list[int]] = {}
    while (m := _TAG.search(page, at, last)) is not None:
        start, at = m.start(), m.end()
        name = (m.group(1) or "").lower()
        if m.group() == "<!--":
            end = page.find("-->", at) + 3 if comment >= at else 0
            if not end:  # no comment: a tag, if anything, up to the next >
                end = page.find(">", at) + 1
            at = end
        elif name:
            if name not in ends:
                ends[name] = [e.end() for e in _ENDS[name].finditer(page, at)][::-1]
            left = ends[name]
            while left and left[-1] <= at:
                left.pop()
            if left:
                at = left[-1]
            else:
                name = ""
        yield start, at, name


class Tokens:
    """Cuts pages into (role, text or None); remembers what it made of tags."""

    def __init__(self) -> None:
        self.tags: dict[str, tuple[str, str, int]] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def tag(self, raw: str) -> tuple[str, str, int]:
        """(token, name, kind): 1 opens, -1 closes, 0 stands alone."""
        found = self.tags.get(raw)
        if found:
            return found
        m = _NAME.match(raw)
        if not m:
            found = ("<!-->" if raw.startswith("<!--") else raw[:2], "", 0)
        else:
            name = m.group(1).lower()
            if raw[1] == "/":
                found = (f"</{name}>", name, -1)
            else:
                attributes = []
                for a, *values in _ATTRIBUTE.findall(raw[m.end() : -1]):
                    a = a.lower()
                    attributes.append(f'{a}="{"".join(values)}"' if a in ("class", "id") else a)
                found = (f"<{' '.join([name, *sorted(attributes)])}>", name, 0 if name in _VOID or raw.endswith("/>") else 1)
        if len(self.tags) < 100_000 and len(raw) < 1000:
            self.tags[raw] = found
        return found

    def under(self, path: int, name: str) -> int:
        """The path one tag further down."""
        found = self.paths.get((path, name))
        if found is None:
            found = xxhash.xxh64_intdigest(f"{path}/{name}") - (1 << 63)
            if len(self.paths) < 100_000:
                self.paths[path, name] = found
        return found

    def __call__(self, page: str) -> Iterator[tuple[int, str, str]]:
        """(path, tag token or '', text): a tag, or a stretch of text."""
        stack: list[tuple[str, int]] = []
        open_: Counter = Counter()
        path, at = 0, 0

        def close(name: str) -> int:
            while True:
                last, above = stack.pop()
                open_[last] -= 1
                if last == name:
                    return above

        for start, end, raw_text in pieces(page):
            if start > at:
                yield path, "", page[at:start]
            at = end
            if raw_text:
                yield path, f"<{raw_text}>", page[start:end]
                continue
            token, name, kind = self.tag(page[start:end])
            if kind == 1 and name in _BLOCK and open_["p"]:
                path = close("p")  # a block ends the paragraph that is open
            elif kind == -1 and open_[name]:
                path = close(name)
            yield path, token, page[start:end]
            if kind == 1:
                stack.append((name, path))
                open_[name] += 1
                path = self.under(path, name)
        if at < len(page):
            yield path, "", page[at:]


def _stretches(tokens: Tokens, page: str) -> Iterator[tuple[int, list[str]]]:
    """(path, tokens): the roles of a page in order, tags one by one and words a stretch of text at a time."""
    for path, tag, text in tokens(page):
        yield path, [tag] if tag else text.split()


def _locally_frequent(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    pages: Counter = Counter()
    support: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for batch in batches:
        for host, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pages[host] += 1
            have: dict[int, set[str]] = {}
            for path, words in _stretches(tokens, page):
                have.setdefault(path, set()).update(words)
            paths = support[host]
            for path, words in have.items():
                paths[path].update(words)
    for host, paths in support.items():
        least = share * pages[host] - 1e-9
        roles = [(path, r) for path, counts in paths.items() for r, n in counts.items() if n >= least]
        columns = [pa.array([host] * len(roles), pa.string()), pa.array([p for p, _ in roles], pa.int64()), pa.array([r for _, r in roles], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "token"])


Known = dict[str, dict[int, dict[str, int]]]  # by host and path, the number of each token


def _numbers(tokens: Tokens, page: str, known: dict[int, dict[str, int]]) -> list[int]:
    """The numbers of those roles of a page that have one, in order."""
    found: list[int] = []
    if known:
        for path, words in _stretches(tokens, page):
            here = known.get(path)
            if here:
                found += [here[w] for w in words if w in here]
    return found


def _count(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    sums: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, r, *v) for (h, r), v in sums.items()]
        sums.clear()
        types = (pa.string(), pa.int32(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=["host", "role_no", "support", "total", "v1", "v2"])

    for batch in batches:
        for page_id, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes: dict[int, int] = {}
            for role, n in Counter(_numbers(tokens, page, known.get(host, {}))).items():
                h = hashes.get(n)
                if h is None:
                    h = hashes[n] = xxhash.xxh64_intdigest(b"%d/%d" % (page_id, n))
                s = sums.setdefault((host, role), [0, 0, 0, 0])
                s[0] += 1
                s[1] += n
                s[2] += h >> 33
                s[3] += h & 0x7FFFFFFF
        if len(sums) > 500_000:
            yield out()
    yield out()


def _skeletons(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        hosts, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [_numbers(tokens, p, known.get(h, {})) for h, p in zip(hosts, pages, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["host", "skeleton"])


Classes = dict[str, dict[int, int]]  # by host, the class of each role number


def _faults(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    """Per page and class: (host, class, fault, order, parent, gap); fault 1 if the page speaks against the class."""
    for batch in batches:
        rows: Counter = Counter()
        for host, skeleton in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = classes.get(host, {})
            sequence = [(of[r], r) for r in skeleton if r in of]
            by: dict[int, list[int]] = defaultdict(list)
            for c, r in sequence:
                by[c].append(r)
            size = Counter(of.values())
            order: dict[int, tuple[int, ...]] = {}
            bad = set()
            for c, rs in by.items():
                k = size[c]
                order[c] = tuple(rs[:k])
                if len(set(order[c])) != k or rs != rs[:k] * (len(rs) // k):
                    bad.add(c)
            parent: dict[int, set] = defaultdict(set)
            stack: list[list[int]] = []
            seen: Counter = Counter()
            for c, _ in sequence:
                if c in bad:
                    continue
                k = seen[c] % size[c]
                seen[c] += 1
                if k == 0:
                    parent[c].add(tuple(stack[-1]) if stack else (0, 0))
                    stack.append([c, 0])
                elif stack and stack[-1][0] == c:
                    stack[-1][1] = k
                else:
                    # classes cross: the one of higher number, of less support, is at fault
                    open_ = next((i for i, s in enumerate(stack) if s[0] == c), None)
                    if open_ is None:
                        continue
                    crossing = [s[0] for s in stack[open_:]]
                    bad.add(max(crossing))
                    stack = [s for s in stack if s[0] != max(crossing)]
                    if max(crossing) == c:
                        continue
                    stack[-1][1] = k if stack and stack[-1][0] == c else stack[-1][1]
                if k == size[c] - 1 and stack and stack[-1][0] == c:
                    stack.pop()
            for c in by:
                wrong = c in bad or len(parent[c]) > 1
                around = min(parent[c]) if parent[c] else (0, 0)
                rows[host, c, int(wrong), xxhash.xxh64_intdigest(str(order[c])) >> 1, *around] += 1
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=["host", "class", "fault", "order", "parent", "gap"])


def plain(fragment: str) -> str:
    """The text of a piece of HTML: tags are blanks, entities are resolved, blanks run together."""
    out, at = [], 0
    for start, end, _ in pieces(fragment):
        out += [fragment[at:start], " "]
        at = end
    return " ".join(entities.unescape("".join([*out, fragment[at:]])).split())


def _slots(page: str, tokens: Tokens, numbers: dict[int, dict[str, int]], of: dict[int, int], size: Counter) -> list[tuple[int, int, int, str]]:
    """(class, occurrence, gap, text) of the slots of a page that hold text."""
    seen: Counter = Counter()
    stack: list[list[int]] = []
    held: dict[tuple[int, int, int], list[str]] = {}
    slot = (0, 0, 0)

    def meet(role: int) -> None:
        nonlocal slot
        c = of[role]
        k = seen[c] % size[c]
        if k == 0:
            stack.append([c, seen[c] // size[c], 0])
        elif stack and stack[-1][0] == c:
            stack[-1][2] = k
        seen[c] += 1
        if k == size[c] - 1 and stack and stack[-1][0] == c:
            stack.pop()
        slot = tuple(stack[-1]) if stack else (0, 0, 0)

    for path, tag, text in tokens(page):
        here = numbers.get(path, {})
        if tag:
            if tag in here:
                meet(here[tag])
            else:
                held.setdefault(slot, []).append(" ")
        elif not here or here.keys().isdisjoint(text.split()):
            held.setdefault(slot, []).append(text)
        else:
            for piece in _BLANKS.split(text):
                if piece in here:
                    meet(here[piece])
                else:
                    held.setdefault(slot, []).append(piece)
    out = [(*s, " ".join(entities.unescape("".join(t)).split())) for s, t in held.items()]
    return [s for s in out if s[3]]


def _extract(batches: Iterator[pa.RecordBatch], known: Known, classes: Classes) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    sizes = {host: Counter(of.values()) for host, of in classes.items()}
    for batch in batches:
        rows = []
        for page_id, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(page_id, host, *s) for s in _slots(page, tokens, known.get(host, {}), classes.get(host, {}), sizes.get(host, Counter()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=["page_id", "host", "class", "occurrence", "gap", "text"])


def _with_table(rows: DataFrame, table: DataFrame, read: Callable, work: Callable, schema: str) -> DataFrame:
    """work(batches of `rows`, read(rows of the small table `table`)), which both have a column host.

    The table goes to every task while it is small; else rows and table meet by host.
    """
    if table_bytes(table) <= BROADCAST_BYTES:
        held = read([tuple(r) for r in table.collect()])
        return rows.mapInArrow(trimmed(lambda batches: work(batches, held)), schema)
    salts = 1 + rows.groupBy("host").count().agg(F.max("count")).first()[0] // SALT_PAGES
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    names = rows.columns

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        held = read([tuple(r.values()) for r in b.drop_columns(["__salt"]).to_pylist()])
        mine = a.select(names)
        batches = mine.to_batches() or [pa.RecordBatch.from_arrays([pa.array([], f.type) for f in mine.schema], schema=mine.schema)]
        return pa.Table.from_batches(list(work(iter(batches), held)))

    return left.groupBy("host", "__salt").cogroup(right.groupBy("host", "__salt")).applyInArrow(both, schema)


def _known(rows: list[tuple]) -> Known:
    out: Known = {}
    for host, path, token, number, *_ in rows:
        out.setdefault(host, {}).setdefault(path, {})[token] = number
    return out


def _classes(rows: list[tuple]) -> Classes:
    out: Classes = defaultdict(dict)
    for host, *_, number, c in rows:
        out[host][number] = c
    return dict(out)


def extract_slots(pages: DataFrame, min_pages: int = MIN_PAGES, min_support: float = MIN_SUPPORT, min_roles: int = MIN_ROLES) -> DataFrame:
    """(page_id, host, class, occurrence, gap, text): what fills the slots of each page.

    gap k of a class is what follows its role k, up to the next; class 0 is outside of all.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
    sizes = stored(sizes.where(F.col("pages") >= min_pages), "hosts")
    whole = sizes.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-whole // TASK_BYTES))
    share = F.pmod(F.xxhash64("page_id"), F.ceil(F.col("pages") / SALT_PAGES))
    near = pages.join(small(sizes), "host").select("page_id", "host", "html", share.alias("share")).repartition(tasks, "host", "share").select("page_id", "host", "html")
    local = near.mapInArrow(trimmed(lambda batches: _locally_frequent(batches, min_support)), "host string, path long, token string").distinct()
    number = (F.row_number().over(Window.partitionBy("host").orderBy("path", "token")) - 1).cast("int")
    roles = stored(local.join(small(sizes.select("host", "pages")), "host").select("host", "path", "token", number.alias("role_no"), "pages"), "roles", TEXT_ROWS)

    counted = _with_table(pages, roles.select("host", "path", "token", "role_no"), _known, _count, "host string, role_no int, support long, total long, v1 long, v2 long")
    vectors = counted.groupBy("host", "role_no").agg(*(F.sum(c).alias(c) for c in ("support", "total", "v1", "v2"))).join(roles, ["host", "role_no"])
    vectors = stored(vectors.where(F.col("support") >= F.greatest(F.lit(2), F.ceil(min_support * F.col("pages") - 1e-9))), "vectors", TEXT_ROWS)
    same = ["host", "support", "total", "v1", "v2"]
    grouped = vectors.groupBy(*same).agg(F.count(F.lit(1)).alias("z"), F.min("role_no").alias("o")).where(F.col("z") >= min_roles)
    # classes are numbered from 1 by host, those of most support and size first
    order = F.row_number().over(Window.partitionBy("host").orderBy(F.col("support").desc(), F.col("z").desc(), "o"))
    classes = vectors.join(grouped.withColumn("class", order).select(*same, "class"), same).select("host", "path", "token", "role_no", "class")
    classes = stored(classes, "classes")

    skeletons = stored(_with_table(pages, classes, _known, _skeletons, "host string, skeleton array<int>"), "skeletons", TEXT_ROWS)
    while True:
        found = _with_table(skeletons, classes, _classes, _faults, "host string, class int, fault int, order long, parent int, gap int")
        differ = lambda c: F.min(c) != F.max(c)
        faulty = found.groupBy("host", "class").agg(F.max("fault").alias("f"), differ("order"), differ(F.struct("parent", "gap")))
        faulty = stored(faulty.toDF("host", "class", "f", "o", "p").where("f > 0 or o or p").select("host", "class"), "faulty", TEXT_ROWS)
        if faulty.isEmpty():
            break
        classes = stored(classes.join(faulty, ["host", "class"], "left_anti").select("host", "path", "token", "role_no", "class"), "classes")

    def work(batches: Iterator[pa.RecordBatch], held: tuple[Known, Classes]) -> Iterator[pa.RecordBatch]:
        return _extract(batches, *held)

    return _with_table(pages, classes, lambda rows: (_known(rows), _classes(rows)), work, "page_id long, host string, class int, occurrence int, gap int, text string")

from __future__ import annotations

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import zstandard

from citeloom.llm import packing, warc

PAGES = [
    (1, "http://a.example/", "<p>one</p>", "x"),
    (1, "http://a.example/", "<p>one</p>", "x"),
    (2, None, None, "x"),
    (None, "http://b.example/", "lost", "x"),
    (3, "http://c.example/é", "ü" * 3000, "x"),
    *((i, f"http://d.example/{i}", f"<p>{i}</p>" * (i % 70), "x") for i in range(10, 300)),
]


def test_bundles_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, bundle string")
    index = warc.bundle_pages(pages, str(tmp_path / "out"), frame_bytes=2000, bundle_bytes=40_000).collect()
    want = sorted((p, u or "", h or "") for p, u, h, _ in PAGES if p is not None)
    got = []
    for r in index:
        path = tmp_path / "out" / r.bundle
        headers, body = warc.parse(warc.read_record(str(path), r.frame, r.offset, r.length))
        assert headers["WARC-Record-ID"] == r.record_id and zlib.crc32(body) == r.body_crc
        start, packed, _ = warc.read_seek_table(str(path))[r.frame]
        assert (start, packed) == (r.frame_start, r.frame_size)
        got.append((r.page_id, headers["WARC-Target-URI"], body.decode()))
    assert sorted(got) == want
    assert len({(r.page_id, r.ordinal) for r in index}) == len(want)
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert not list((tmp_path / "out").glob(".bundle-*[!c]"))
    assert {f.name for f in files} == {r.bundle for r in index} and len(files) > 1
    # a plain decoder reads the frames one after another and skips the table
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read() for f in files)
    assert len(plain) == sum(r.length for r in index)


def test_urls_stay_one_header_and_long_pages_one_frame(spark, tmp_path):
    urls = ["http://a/\r\nX", "http://a/\r\nContent-Length: 3\r\n\r\nabc", "http://a/\u0085\u2028x\ty", "http://a/ok?b=c: d"]
    long = "<p>" + "text of a page " * 1_400_000 + "</p>"
    pages = spark.createDataFrame([(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)] + [(9, "http://a/long", long)], "page_id long, url string, html string")
    index = warc.bundle_pages(pages, str(tmp_path / "out"), frame_bytes=2000).collect()
    assert len(long) > 20_000_000 and len(index) == 5
    for r in index:
        headers, body = warc.parse(warc.read_record(str(tmp_path / "out" / r.bundle), r.frame, r.offset, r.length))
        assert len(headers) == 6 and body.decode() == (long if r.page_id == 9 else f"<p>{r.page_id}</p>")
    assert warc.header_url(urls[0]) == "http://a/%0D%0AX" and warc.header_url(urls[3]) == urls[3]


def test_written_once(spark, tmp_path):
    index = warc.bundle_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string, bundle string"), str(tmp_path / "out"))
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").glob("*.zst")}
    assert before and index.count() == index.count() == spark.read.parquet(str(tmp_path / "out" / "index")).count()
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").glob("*.zst")} == before


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.bundle_pages(pages, str(tmp_path / "out")).collect() == []


def _check(rows, limits):
    bins = defaultdict(list)
    for r in rows:
        bins[(r.shard, r.bin_no)].append(r)
    for members in bins.values():
        assert sorted(m.position for m in members) == list(range(len(members)))
        if any(m.oversize for m in members):
            assert len(members) == 1
        else:
            assert sum(m.tokens for m in members) <= limits[0] and len(members) <= limits[1] and sum(m.loss_tokens for m in members) <= limits[2]
    return bins


def test_bins_hold_their_limits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(t), int(t * f)) for i, (t, f) in enumerate(zip(rng.integers(0, 700, 900), rng.random(900), strict=True))]
    rows += [(1000, 5000, 1), (1001, 10, 4000), (1002, None, None), (1003, 0, 0), (1, *rows[1][1:]), (None, 5, 5)]
    got = packing.pack_examples(spark.createDataFrame([(*r, 7, 8) for r in rows], "id long, tokens long, loss_tokens long, shard int, bin_no int"), 2048, 8, 1500, shard_rows=200).collect()
    assert sorted(r.id for r in got) == sorted(i for i, *_ in rows if i is not None)
    bins = _check(got, (2048, 8, 1500))
    least = max(sum(min(r.tokens, 2048) for r in got) / 2048, len(got) / 8, sum(min(r.loss_tokens, 1500) for r in got) / 1500)
    assert len(bins) <= 1.25 * least + 6


def greedy(examples, limits):
    """(bin, position) of each example, one at a time, among all that are left; ties by demand, then by order."""
    left, places, b = [], {}, 0
    for e, (t, x) in enumerate(examples):
        if t > limits[0] or x > limits[2]:
            left.append((t, x, e))
    for _, _, e in sorted(left):
        places[e] = (b, 0)
        b += 1
    left = {e for e in range(len(examples)) if e not in places}
    share = lambda e: [Fraction(x, m) for x, m in zip((examples[e][0], 1, examples[e][1]), limits, strict=True)]
    while left:
        room, position = [Fraction(1)] * 3, 0
        while True:
            fit = [e for e in left if all(s <= r for s, r in zip(share(e), room, strict=True))]
            if not fit:
                break
            e = min(fit, key=lambda e: (-sum(s * r for s, r in zip(share(e), room, strict=True)), *examples[e], e))
            places[e] = (b, position)
            left.discard(e)
            room, position = [r - s for r, s in zip(room, share(e), strict=True)], position + 1
        b += 1
    return [places[e] for e in range(len(examples))]


def test_matches_the_heuristic_by_brute_force():
    """Limits are powers of two, so that scores are exact and ties are ties."""
    rng = np.random.default_rng(3)
    for k in range(12):
        tokens = rng.integers(0, (20, 70, 140)[k % 3], 90)
        loss = rng.integers(0, 40, 90) // (1 + k % 2 * 7)
        bins, places = packing.pack(tokens, loss, (128, 8, 32))
        assert list(zip(bins.tolist(), places.tolist(), strict=True)) == greedy(list(zip(tokens.tolist(), loss.tolist(), strict=True)), (128, 8, 32))


def test_pack_nothing(spark):
    assert packing.pack_examples(spark.createDataFrame([], "id long, tokens long, loss_tokens long")).collect() == []


def test_conversations_count_the_assistant_as_loss(spark):
    rows = [(1, 0, "user", "a b!"), (1, 1, "assistant", "c"), (2, 0, "user", None), (None, 0, "user", "x")]
    got = packing.conversation_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 8, 3), (2, 2, 0)]


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "assistant", "a b", 5, 6, 7)]
    got = packing.conversation_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id int, n int, tokens int"))
    assert [tuple(r) for r in packing.pack_examples(got).collect()] == [(1, 0, 0, 0, 4, 4, False)]

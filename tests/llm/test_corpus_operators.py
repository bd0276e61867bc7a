"""Operators over a whole corpus against brute force, with odd input and hot groups."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storelens.llm import ann, archives, mixing, simhash, substring_dedup
from tests.llm.conftest import prose


# Nearest neighbours


def brute_nearest(vectors, k):
    good = [(i, np.array(v, float)) for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in good:
        if q % 100:
            continue
        best = {}
        for i, b in good:
            if i != q and len(a) == len(b):
                d = 0.0
                for x, y in zip(a, b):
                    d += (x - y) * (x - y)
                best[i] = min(best.get(i, math.inf), math.sqrt(d))
        ranked = sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]
        out |= {(q, r, i, d) for r, (i, d) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("blocks", [(2048, 8192), (2, 37)])
def test_nearest_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "BASE_BLOCK", blocks[1])
    monkeypatch.setattr(ann, "MERGE", 3)
    rng = random.Random(4)
    vectors = [(i, [round(rng.gauss(0, 1), 2) for _ in range(6)]) for i in range(700)]
    vectors += [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]) for i in range(1000, 1250)]  # one common vector
    vectors += [(2000, None), (2100, [0.0] * 6), (2200, [1.0, None] + [0.0] * 4), (2300, [float("nan")] * 6),
                (2400, [float("inf")] + [1.0] * 5), (2500, []), (None, [1.0] * 6), (2600, [1.0, 2.0]),
                (2601, [1.5, 2.0]), (300, vectors[300][1]), (301, vectors[301][1])]
    df = spark.createDataFrame(
        [(i, v, 7, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank int, tile string")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
              for i, v in vectors]
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert {tuple(r) for r in found} == brute_nearest(single, 10)
    assert ann.nearest(df.where("vec_id < 0"), F.lit(True)).collect() == []
    assert ann.nearest(df.where("vec_id = 100"), F.lit(True)).collect() == []


# Substring dedup


def brute_strip(rows, window=20):
    """(id, n_words, n_removed, digest) of each row; rows of one id stand at one place."""
    low = -(2**63)
    split = [(low if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for key, words in split:
        for i in range(len(words) - window + 1):
            name = b" ".join(words[i:i + window])
            first[name] = min(first.get(name, (key, i)), (key, i))
    out = []
    for (key, words), row in zip(split, rows):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[b" ".join(words[i:i + window])] < (key, i):
                gone[i:i + window] = [True] * window
        left = [w for w, g in zip(words, gone) if not g]
        out.append((row[0], len(words), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def passage_rows(odd_rows):
    rng = random.Random(8)
    shared = [prose(70 + i, 55) for i in range(4)]
    rows = [r[:2] for r in odd_rows]
    for i in range(120):
        words = prose(800 + i, rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            part = rng.choice(shared)
            a = rng.randrange(0, 30)
            words[at:at] = part[a:] if rng.random() < 0.5 else part
        if i % 9 == 0:
            words = ["The"] * rng.randrange(15, 90) + words
        if i % 3 == 0:
            words += shared[0]  # one very common passage
        rows.append((1000 - i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(2000 + i, "\n".join([" ".join(prose(5, 33))] * 3)) for i in range(40)]  # repeats inside, copies
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats_are_removed_exactly(make_docs, odd_rows, monkeypatch, small):
    if small:  # many buckets and chunks, a short memory, and common seeds
        monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
        monkeypatch.setattr(substring_dedup, "COMMON_LEAST", 2)
        monkeypatch.setattr(substring_dedup, "SAMPLE_OF", 2)
        monkeypatch.setattr(substring_dedup, "_REMEMBERED", 5)
        monkeypatch.setattr(substring_dedup, "chunks", lambda sizes, most=0: [(i, i + 1) for i in range(len(sizes))])
    rows = passage_rows(odd_rows)
    found = substring_dedup.without_repeats(make_docs(rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_strip(rows)


def test_stripped_rows_keep_all_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = substring_dedup.stripped_rows(docs).select("_row.*", F.col("kept").alias("left")).collect()
    assert len(found) == len(odd_rows) and found[0]["kept"] == "w"
    for r in found:
        if r["doc_id"] in (3, 4, 5, 7):
            assert r["left"] == r["text"]
    assert substring_dedup.without_repeats(make_docs([])).collect() == []


def test_two_texts_of_one_id_both_lose_a_known_passage(make_docs):
    shared = " ".join(prose(7, 24))
    rows = [(1, "start " + shared), (5, f"{shared} one end"), (5, f"{shared} other end"), (5, f"{shared} one end")]
    found = substring_dedup.without_repeats(make_docs(rows).coalesce(1)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (5, 24), (5, 24), (5, 24)]


def test_equal_hashes_do_not_join_different_words(monkeypatch):
    monkeypatch.setattr(
        substring_dedup, "rolling", lambda v, n: np.zeros(max(0, len(v) - n + 1), np.uint64))
    packer = substring_dedup.Packer(1, np.empty(0, np.uint64))
    texts = [" ".join(prose(1, 25)), " ".join(prose(2, 22)), " ".join(prose(1, 25)[2:] + ["new"])]
    rows = list(packer([1, 2, 3], [0, 0, 0], [t.encode() for t in texts]))
    key, _, start, count = substring_dedup.repeated([(w, p) for _, w, p in rows])
    assert list(zip(key.tolist(), start.tolist(), count.tolist())) == [(3, 0, 4)]


# SimHash


def brute_print(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i:i + words]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_rows(odd_rows):
    rng = random.Random(6)
    rows = list(odd_rows)
    for i in range(25):
        words = prose(600 + i, rng.randrange(40, 200))
        for k in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] += "x"
            rows.append((1000 + 10 * i + k, " ".join(copy)))
    base = prose(5, 300)
    for i in range(60):  # one large group of near copies
        rows.append((5000 - i, " ".join(base[:150 + i] + [f"q{i}"] + base[150 + i:])))
    rows += [(7000 + i, "same words here and there") for i in range(80)]  # and one of exact ones
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_links_and_components_are_exact(make_docs, odd_rows, monkeypatch, small):
    if small:
        monkeypatch.setattr(simhash, "BLOCK", 8)
        monkeypatch.setattr(simhash, "SMALL_RUN", 2)
        monkeypatch.setattr(simhash, "in_blocks", lambda rows, f=simhash.in_blocks: f(rows, most=8))
        monkeypatch.setattr(simhash, "part_count", lambda n, b: 3)
    rows = near_rows(odd_rows)
    prints = [brute_print(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                             if (prints[i] ^ prints[j]).bit_count() <= 3])
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[root[i]] = min(r[0], smallest.get(root[i], r[0]))
    expected = sorted(((r[0], prints[i], smallest.get(root[i])) for i, r in enumerate(rows)), key=str)
    found = simhash.near_duplicates(make_docs(rows).repartition(3)).collect()
    assert sorted(((a, b % 2**64, c) for a, b, c in found), key=str) == expected
    assert simhash.near_duplicates(make_docs([])).collect() == []


@pytest.mark.parametrize("n,graphs", [(1500, 20), (3000, 4)])
def test_spanning_keeps_every_link_of_large_buckets(n, graphs):
    """Sparse graphs in several chunks of rows, against union-find."""
    for seed in range(graphs):
        rng = np.random.default_rng(seed)
        linked = np.zeros((n, n), bool)
        a, b = rng.integers(0, n, (2, n * 6 // 10))
        linked[a, b] = linked[b, a] = True
        found = simhash.spanning(
            np.zeros(n, np.uint64), np.zeros(n, np.int8), lambda rows, cols: linked[rows, cols])
        assert found.tolist() == roots(n, zip(a.tolist(), b.tolist()))


def test_thresholds_keep_the_guarantee():
    rng = random.Random(1)
    for n, max_bits in ((100, 3), (10**6, 3), (10**9, 3), (10**5, 10)):
        parts = simhash.part_count(n, max_bits)
        widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
        chosen = simhash.thresholds(n, max_bits, widths, [rng.random() for _ in widths])
        assert sum(chosen) == max_bits - parts + 1 and min(chosen) >= -1
    together = np.full((64, 64), 25.0) + 25 * np.eye(64)
    together[3, 60] = together[60, 3] = 50
    grouped = simhash.grouped_bits(together, 100, 4)
    assert sorted(b for g in grouped for b in g) == list(range(64)) and any({3, 60} <= set(g) for g in grouped)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 300), (500, 400)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long").selectExpr(
        "least(a, b) AS a", "greatest(a, b) AS b")).collect()
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {300: 0, 400: 400, 500: 400}
    assert dict(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("small", [True, False])
def test_one_document_of_each_component_stays(make_docs, odd_rows, monkeypatch, small):
    if not small:  # the rows to leave out are shuffled instead of broadcast
        monkeypatch.setattr(simhash, "is_small", lambda df: False)
    rows = near_rows(odd_rows) + [(7000, "same words here and there"), (7000, "other words of the same id")]
    prints = [brute_print(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                             if (prints[i] ^ prints[j]).bit_count() <= 3])
    low = -(2**63)
    first = {}
    for i, r in enumerate(rows):
        first[root[i]] = min(first.get(root[i], math.inf), low if r[0] is None else r[0])
    docs = make_docs(rows).repartition(3)
    kept = simhash.without_copies(docs)
    assert kept.schema == docs.schema
    found = kept.collect()
    assert sorted(low if r["doc_id"] is None else r["doc_id"] for r in found) == sorted(first.values())
    given = {str(r) for r in docs.collect()}
    assert all(str(r) in given for r in found)  # every column as it was
    assert simhash.without_copies(make_docs([])).collect() == []


def test_rows_of_one_id_and_one_component_leave_one(make_docs):
    docs = make_docs([(3, ""), (3, " \t"), (3, None), (3, ""), (None, "a b c d"), (None, "a b c d"), (9, "a b c d")])
    kept = simhash.without_copies(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None"]


# Archives


def page_rows():
    html = ["<p>one</p>", "<p>one</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é\n\n\r\n filedesc:x",
            "<p>one</p>", "x" * 300_000, "http://a 1.1.1.1 20000101000000 text/html 5"]
    rows = [(i, f"http://h{i}/ä b\n{i}", h) for i, h in enumerate(html)]
    return rows + [(20, None, "<p>one</p>"), (None, "http://n/", "<p>two</p>"), (21, "http://z/", "<p>two</p>"),
                   (22, "http://y/", "twice"), (22, "http://y/", "twice")]


def expected_records(rows):
    def sha(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    keeper = {}
    for i, (page, _, h) in enumerate(rows):
        place = (-1 if page is None else page, i)
        keeper[sha(h)] = max(keeper.get(sha(h), place), place)
    out = []
    for i, (page, _, h) in enumerate(rows):
        kept, at = keeper[sha(h)]
        kind = ("response", None) if at == i else ("revisit", kept)
        out.append((page, len((h or "").encode()), sha(h), *kind))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_pages_through_arc_and_warc(spark, tmp_path, version):
    rows = page_rows()
    pages = spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, value string").coalesce(1)
    archives.write_arc(pages, f"{tmp_path}/arc", version)
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    records = archives.read_warc(spark, f"{tmp_path}/warc")
    found = archives.page_records(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in found), key=str) == expected_records(rows)
    kept = records.collect()
    assert all(r["intact"] for r in kept)
    held = {r["page"]: bytes(r["payload"]).decode() for r in kept if r["type"] == "response"}
    assert held[4] == rows[4][2] and held[7] == rows[7][2] and held[3] == ""
    assert {r["date"] for r in kept} == {"2000-01-01T00:00:00Z"}
    assert "http://h5/ä%20b%0A5" in {r["uri"] for r in kept} and "-" in {r["uri"] for r in kept}


def test_short_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/", "same") for i in range(6)], "page_id long, url string, html string")
    archives.write_arc(pages, f"{tmp_path}/arc")
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", least_bytes=5)
    assert {r["type"] for r in archives.read_warc(spark, f"{tmp_path}/warc").collect()} == {"response"}


def test_no_pages(spark, tmp_path):
    archives.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/arc")
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert archives.page_records(archives.read_warc(spark, f"{tmp_path}/warc")).collect() == []


def test_arc_lines_by_declared_fields_and_lengths():
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    data = (
        b"filedesc://a 0.0.0.0 20010203040506 text/plain %d\n" % len(block) + block + b"\n"
        b"http://a b/ 1.2.3.4 20010203 text/html 9\nHTTP/ab\ncd\n"[:0]
        + b"dns:x 1.2.3.4 20010203 text/dns 4\n1\n2\n\nnot a header\n"
        + b"http://a/b c 1.2.3.4 200102030405 text/html 50\nHTTP/1.0 200 OK\n\ncut"
    )
    records = list(archives.arc_records(data))
    assert [r["url"] for r in records] == ["filedesc://a", "dns:x", "http://a/b c"]
    assert records[1]["block"] == b"1\n2\n" and not records[1]["truncated"] and records[2]["truncated"]
    assert archives.split_http(records[2]["block"])[1] == b"cut"
    assert [archives.w3c_date(d) for d in ("20010203", "200102030405", "20010203040506", "x")] == [
        "2001-02-03T00:00:00Z", "2001-02-03T04:05:00Z", "2001-02-03T04:05:06Z", "1970-01-01T00:00:00Z"]
    import gzip

    twice = gzip.compress(data[:100]) + gzip.compress(data[100:])
    assert [r["block"] for r in archives.arc_records(twice)] == [r["block"] for r in records]


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def mix_rows(odd_rows):
    rng = random.Random(3)
    rows = list(odd_rows)
    rows += [(100 + i, " ".join(prose(i, rng.randrange(1, 60))), "hot") for i in range(900)]
    rows += [(2000 + i, " ".join(prose(i, 30)), f"s{i % 7}") for i in range(300)]
    return rows + [(3000 + i, None, "nothing") for i in range(5)]


def test_mix_meets_its_targets(make_docs, odd_rows):
    rows = mix_rows(odd_rows)
    sizes, sources = {}, {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    expected = brute_targets(sizes)
    docs = make_docs(rows)
    found = mixing.mix_sources(docs.repartition(4)).collect()
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert math.isclose(r["target"], expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(ratio) <= r["copies"] <= math.ceil(ratio) <= 3 and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in expected.items():
        largest = max(len((t or "").split()) * 2 for _, t, s in rows if s == source)
        assert abs(taken[source] - target) <= largest + 1e-6
    again = mixing.mix_sources(docs.repartition(9, "size")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix_sources(make_docs([])).collect() == []


def test_copies_are_right_on_average(make_docs):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(300)]
    docs = make_docs(rows)
    runs = [{r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, seed=s).collect()} for s in range(6)]
    one = mixing.mix_sources(docs).where("doc_id < 2").collect()
    for r in one:
        mean = np.mean([run[i] for run in runs for i, _, s in rows if s == "ab"[r["doc_id"] % 2]])
        assert abs(mean - r["target"] / r["source_size"]) < 0.06
    assert len({tuple(sorted(run.items())) for run in runs}) > 1


# Pipeline


def test_stages_decide_and_run_agrees(spark, sf, make_docs, odd_rows, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        odd = stage(spark, make_docs(odd_rows), sf)
        assert odd.dtypes == make_docs(odd_rows).dtypes and odd.count() <= len(odd_rows)
        assert stage(spark, make_docs([]), sf).count() == 0
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(map(str, last)) == sorted(map(str, pipeline.run(spark, sf).collect()))


def _arc(*records, date="20010203040506"):
    block = f"1 0 x\n{archives.ARC_FIELDS[1]}\n".encode()
    out = f"filedesc://x 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block + b"\n"
    for url, when, body in records:
        out += f"{url} 0.0.0.0 {when} text/html {len(body)}\n".encode() + body + b"\n"
    return out


def test_real_old_archives(spark, tmp_path):
    """Heads that lack a length, lie about it or hold text; gzip that is padded or damaged; digits that are no date."""
    import gzip

    def page(i, head=b""):
        return b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\n" % i + head + b"\r\nnine byte"

    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "a.arc").write_bytes(_arc(
        ("http://a", "20011399000000", page(1)), ("http://b", "20010203040506", page(2)),
        ("http://c", "x", page(3, b"Content-Length: 1000\r\n")), ("http://d", "2001", page(4, b"Content-Length: ten\r\n"))))
    member = gzip.compress(_arc(("http://e", "20010203", page(5))))
    (folder / "b.arc.gz").write_bytes(member + b"\0" * 700)
    noise = b"".join(bytes([i * 7 % 251]) for i in range(9000))
    (folder / "c.arc.gz").write_bytes(member + gzip.compress(noise)[:40] + b"garbage" * 50)
    archives.convert(spark, str(folder), f"{tmp_path}/warc")
    rows = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert {r["payload_bytes"] for r in rows} == {9} and all(r["intact"] for r in rows)
    found = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.page_records(
        spark.createDataFrame(rows, archives.read_warc(spark, f"{tmp_path}/warc").schema)).collect())
    assert [f[0] for f in found] == [1, 2, 3, 4, 5, 5]
    assert [f[1] for f in found].count("response") == 1
    assert {f[2] for f in found if f[1] == "revisit"} == {5}
    assert {r["date"] for r in rows if r["page"] == 1} == {"1970-01-01T00:00:00Z"}


def test_bad_lengths_do_not_end_the_reading():
    good = archives.warc_record("response", [("WARC-Record-ID", "<b>")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: twelve\r\n\r\n"
    huge = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + b"9" * 30 + b"\r\n\r\n"
    blocks = [b for _, b in archives.warc_records(bad + b"\r\n\r\n" + good + b"\r\n\r\n" + huge)]
    assert blocks == [b"", b"HTTP/1.1 200 OK\r\n\r\nbody", b""]

import base64
import gzip
import hashlib

from geofold.llm import _store, warc


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


PAGES = [(i, f"http://h/{i}?q=é", f"<p>{i % 7}</p>" * 20, "x") for i in range(60)] + [(100, None, None, "x"), (101, "u\r\nInjected: 1", "", "x"), (None, "n", "<p>only null</p>", "x"), (None, None, "<p>0</p>" * 20, "x"), (59, "again", "<p>3</p>" * 20, "x"), (200, "big", "WARC/1.1\r\n\r\n" + "é" * 300_000, "x")]
SCHEMA = "page_id long, url string, html string, n long"


def frame(spark):
    return spark.createDataFrame([(a, b, c, 1) for a, b, c, _ in PAGES], SCHEMA).repartition(3)


def test_revisits_point_to_the_largest_page(spark):
    heads, folder = warc.deduplicate(frame(spark))
    rows = heads.collect()
    assert len(rows) == len(PAGES)
    top = {}
    for i, _, html, _ in PAGES:
        k = sha(html)
        top[k] = max(top.get(k, -1), -1 if i is None else i)
    seen = {}
    for r in rows:
        k = r["payload_digest"]
        if r["record_type"] == "response":
            assert k not in seen
            seen[k] = r["page_id"]
            assert (-1 if r["page_id"] is None else r["page_id"]) == top[k] and r["refers_to"] is None
        else:
            assert r["refers_to"] == top[k]
    assert set(seen) == set(top)
    want = sorted((str(i), u, len((h or "").encode()), sha(h)) for i, u, h, _ in PAGES if u)
    assert sorted((str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"]) for r in rows if r["url"]) == want


def test_archives_are_plain_gzip_members(spark):
    heads, folder = warc.deduplicate(frame(spark))
    fs, _ = _store.local_or_fs(folder)
    n, payloads = 0, {}
    for path in {r["path"] for r in heads.collect()}:
        with open(path, "rb") as f:
            whole = gzip.decompress(f.read())
        n += whole.count(b"WARC-Record-ID: <urn:uuid:")
        for _, raw in warc.members(folder, path):
            fields, payload = warc.parse(raw)
            assert "Injected" not in fields
            if fields["WARC-Type"] == "response":
                payloads[fields["WARC-Record-ID"]] = payload
            else:
                assert payload == b"" and "WARC-Refers-To" in fields
    assert n == len(PAGES)
    assert {sha(p.decode()) for p in payloads.values()} == {sha(h) for _, _, h, _ in PAGES}


def test_threshold_and_empty_table(spark):
    heads, _ = warc.deduplicate(frame(spark), at_least=10**7)
    assert {r["record_type"] for r in heads.collect()} == {"response"}
    assert warc.deduplicate(frame(spark).limit(0))[0].count() == 0


def test_files_roll(spark, monkeypatch):
    folder = _store.scratch(spark, "t")
    w = warc.Writer(folder)
    monkeypatch.setattr(warc, "ROLL", 200)
    for i in range(4):
        w.add(warc.record("response", i, "u", b"abc", 3, warc.digest(b"abc")))
    assert w.report().num_rows > 1

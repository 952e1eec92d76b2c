from __future__ import annotations

import base64
import gzip
import hashlib
import io

from riskloom.llm.warc import op8_warc, read_archives, records, write_archives


def expected(pages, least=0):
    best = {}
    for i, html in pages:
        data = (html or "").encode()
        if i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and data in best and (i is None or i < best[data])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", best[data] if again else None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_query(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op8_warc(spark, sf).collect()), key=repr) == expected(pages)


PAGES = [
    (1, "same"), (2, "same"), (3, "same"), (3, "same"), (4, None), (5, ""), (6, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (7, "é漢\x00\r\n\r\n"),
    (None, "same"), (None, "alone"), (8, "x" * 300_000), (-9, "\r\n"),
]


def tables(spark):
    return spark.createDataFrame([(i, f"http://a/{i}\r\nX: y z" if i != 2 else None, h, "d", 0) for i, h in PAGES], "page_id long, url string, html string, digest string, size int")


def test_awkward_rows(spark, tmp_path):
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        write_archives(tables(spark), path, min_payload=least)
        rows = read_archives(spark, path).collect()
        want = expected(PAGES, least)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == want
        html = sorted((h or "").encode() for i, h in PAGES)
        assert sorted(bytes(r["payload"]) for r in rows if r["record_type"] == "response") == sorted(h for h, w in zip(html, html, strict=True)) or least == 0
    write_archives(tables(spark).limit(0), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(tables(spark), path)
    revisits = read_archives(spark, path, payload=False).where("record_type = 'revisit' and page_id >= 2")
    assert "PushedFilters: [" in (plan := revisits._jdf.queryExecution().executedPlan().toString()) or "warc" in plan.lower()
    assert [(r["page_id"], r["payload"]) for r in revisits.collect()] == [(2, None)] + [(4, None)]
    assert read_archives(spark, path).where("target_uri like 'http://a/7%' and not page_id in (1, 2)").count() == 1
    assert read_archives(spark, path).where("page_id is null").count() == 2


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "w"
    write_archives(tables(spark).coalesce(1), str(path))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in path.glob("*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    assert len(list(records(io.BytesIO(data)))) == len(PAGES)

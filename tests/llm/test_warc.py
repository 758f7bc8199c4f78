import gzip
import hashlib
import os

import pytest

from keyspan.llm import warc as A

LONG = "<p>" + "long enough to be revisited " * 6 + "</p>"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 40)) for i in range(60)]
    rows += [(100 + i, "http://copy/ü\r\nX: y", LONG) for i in range(5)] + [(50 + i, None, LONG) for i in range(2, 4)] + [(52, "u", LONG), (52, "v", "short"), (200, "n", None), (201, "n", ""), (None, "n", LONG), (300, "é", "é" * 200_000)]
    return rows


def expected(rows):
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out, used = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in first and (i != first[h] or h in used)
        if h in first and i == first[h]:
            used.add(h)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "d") for r in pages()], "page_id long, url string, html string, digest string")
    out = []
    for n, parts in (("a", 3), ("b", 7)):
        folder = str(tmp_path / n)
        manifest = A.write_warc(spark, df.repartition(parts), folder, roll_bytes=2000)
        got = [tuple(r) for r in A.read_warc(manifest, folder).collect()]
        assert sorted(got, key=key) == sorted(expected(pages()), key=key)
        listed = {r["file"]: r for r in manifest.collect()}
        assert set(listed) == set(os.listdir(folder)) and len(listed) > 4
        for name, r in listed.items():
            data = (tmp_path / n / name).read_bytes()
            assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"]
        spans = sorted((r["first_id"], r["last_id"]) for r in listed.values() if r["first_id"] is not None)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        out.append(b"".join(gzip.decompress((tmp_path / n / name).read_bytes()) for name in sorted(listed)))
    assert out[0] == out[1]  # the same records whatever the input's partitions


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", LONG), (2, "v", "x" * 300)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    manifest = A.write_warc(spark, df, folder)
    name = manifest.first()["file"]
    data = gzip.decompress((tmp_path / "w" / name).read_bytes())
    (tmp_path / "w" / name).write_bytes(gzip.compress(data.replace(b"xxx", b"xyx", 1).replace(b"revisited", b"revisitad", 1)))
    with pytest.raises(Exception, match="damaged"):
        A.read_warc(manifest, folder).collect()


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "none")
    manifest = A.write_warc(spark, spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and A.read_warc(manifest, folder).count() == 0

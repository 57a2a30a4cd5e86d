import hashlib
import io
import random
import zipfile

import pytest

from kinetable.llm import warc as W
from kinetable.llm.common import shared_folder


def archive(data=b"abc", index=b"x", **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **kw) as z:
        with z.open(W.DATA_NAME, "w", force_zip64=True) as f:
            f.write(data)
        z.writestr(W.INDEX_NAME, index)
    return out.getvalue()


def test_directory_and_offsets():
    raw = archive(b"12345", b"yy")
    f = io.BytesIO(raw)
    data, index = W.directory(f, len(raw))
    assert (data.name, data.size, data.stored, index.size) == (W.DATA_NAME, 5, True, 2)
    assert raw[W.data_offset(f, data) :][:5] == b"12345"
    assert not W.directory(io.BytesIO(z := archive(b"1" * 999, compression=zipfile.ZIP_DEFLATED)), len(z))[0].stored


def test_comment_with_end_mark():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"hello")
        z.comment = b"x" + W.END + b"y" * 30
    raw = out.getvalue()
    assert [m.name for m in W.directory(io.BytesIO(raw), len(raw))] == ["a"]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(20):
            z.writestr(f"m{k}", b"%d" % k * 60)
    raw = out.getvalue()
    assert W.END64 in raw
    f = io.BytesIO(raw)
    got = W.directory(f, len(raw))
    assert [m.name for m in got] == [f"m{k}" for k in range(20)]
    for k, m in enumerate(got):
        assert W._read(f, W.data_offset(f, m), m.size) == b"%d" % k * 60


@pytest.mark.parametrize("raw", [b"", b"PK", b"x" * 100, archive()[:-10]])
def test_broken_packages_are_errors(raw):
    with pytest.raises(ValueError):
        W.directory(io.BytesIO(raw), len(raw))


def test_record_round_trip():
    body = "a\r\n\r\nbé".encode()
    x = W.parse_record(W.record(-3, "http://x/\r\nEvil: 1", body, len(body), hashlib.sha256(body).hexdigest(), None))
    assert (x["record_id"], x["record_type"], x["payload"], x["url"]) == ("<urn:page:-3>", "response", body, "http://x/%0D%0AEvil:%201")
    x = W.parse_record(W.record(None, None, None, 77, "d", 5))
    assert (W.page_of(x["record_id"]), x["record_type"], x["payload"], x["payload_bytes"], W.page_of(x["refers_to"]), x["url"]) == (None, "revisit", None, 77, 5, None)


@pytest.mark.parametrize("package, span", [(1 << 30, 1 << 23), (300, 1), (2000, 500)])
def test_pages(spark, package, span):
    rng = random.Random(0)
    bodies = [None, "", "short", "x" * 99, "x" * 100, "é" * 50, "é" * 49, *("".join(rng.choices("ab<>\r\n", k=rng.randint(90, 3000))) for _ in range(20))]
    rows = [(i, rng.choice([None, f"http://h/{i}"]), rng.choice(bodies), "d", 1) for i in rng.sample(range(1000), 150)]
    rows += [(None, "u", "x" * 100, "d", 1), rows[0], (None, None, "only nulls " * 20, "d", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n_bytes int")
    folder = shared_folder(spark)
    got = W.read_records(W.ranges(W.write_packages(df, folder, package_bytes=package), folder, range_bytes=span), folder, payloads=True).collect()
    low = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            low[b] = min(i, low.get(b, i))
    want = []
    for i, u, h, *_ in rows:
        b = (h or "").encode()
        first = low.get(b)
        again = first is not None and first != i
        want.append((i, u, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest(), None if again else b))
    assert sorted(map(repr, want)) == sorted(repr((W.page_of(r.record_id), r.url, r.record_type, W.page_of(r.refers_to), r.payload_bytes, r.payload_digest, r.payload if r.payload is None else bytes(r.payload))) for r in got)
    assert sorted(repr(tuple(r)) for r in W.archived(spark, df).collect()) == sorted(repr((w[0], w[4], w[5], w[2], w[3])) for w in want)


def test_empty(spark):
    assert W.archived(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

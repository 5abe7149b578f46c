import gzip
import zlib

from tallyforge.llm import warc

PAGES = "page_id long, url string, html string, record string, n_links string"
HTML = "<html><head><title>A &amp; B</title><script>x</script></head><body><p>One  two<p>thr&eacute;e <a href='/x?a=1&amp;b=2'>four</a></p></body></html>"


def test_derivatives_point_to_their_source():
    source = warc.response("7", "http://h/p", HTML)
    fields, block = warc.parse(source)
    rows = {r[0]: r for r in warc.derivatives(source)}
    assert set(rows) == {"metadata", "conversion"}
    for kind, (_, rid, refers, target, paid, digest, links, chars, record) in rows.items():
        f, b = warc.parse(record)
        assert f["warc-type"] == kind and f["warc-record-id"] == rid
        assert refers == f["warc-refers-to"] == fields["warc-record-id"]
        assert target == f["warc-target-uri"] == f["warc-refers-to-target-uri"] == "http://h/p"
        assert paid == f["warc-source-payload-digest"] == fields["warc-payload-digest"] == warc.digest(HTML.encode())
        assert digest == f["warc-block-digest"] == warc.digest(b) and int(f["content-length"]) == len(b)
        assert f["warc-refers-to-date"] == fields["warc-date"] and (links, chars) == (1, len("One two\nthrée four"))
    a, b = (warc.parse(rows[k][-1])[0] for k in ("metadata", "conversion"))
    assert a["warc-concurrent-to"] == b["warc-record-id"] and b["warc-concurrent-to"] == a["warc-record-id"]
    assert warc.parse(rows["conversion"][-1])[1].decode() == "One two\nthrée four"
    told = warc.parse(rows["metadata"][-1])[1].decode().split("\r\n")
    assert {"title: A & B", "outlink: /x?a=1&b=2", "http-status: HTTP/1.1 200 OK", "http-header-content-type: text/html; charset=utf-8"} <= set(told)


def test_a_head_without_its_end_hides_no_text():
    for page in ("<head><title>t</title><script>'<p>'</script><body><p>x", "<head><meta a=b><p>x</p>", "<head><title>a<b</title>x", "<html><head><title>t</title></head><p>x"):
        assert warc.plain_text(page) == "x"


def coded(headers, body):
    block = b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-IP-Address", "192.0.2.1")], block)


def text(record):
    return next(warc.parse(r[-1])[1].decode() for r in warc.derivatives(record) if r[0] == "conversion")


def test_codings_and_charsets():
    page = "<p>œuvre été</p>"
    raw = page.encode()
    chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(raw[i : i + 5]), raw[i : i + 5]) for i in range(0, len(raw), 5)) + b"0\r\n\r\n"
    assert text(coded(b"Transfer-Encoding: chunked", chunks)) == "œuvre été"
    assert text(coded(b"Content-Encoding: gzip", gzip.compress(raw))) == "œuvre été"
    assert text(coded(b"Content-Encoding: deflate", zlib.compress(raw))) == text(coded(b"Content-Encoding: deflate", zlib.compress(raw)[2:-4])) == "œuvre été"
    assert text(coded(b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", raw)) == "œuvre été"  # neither is true
    assert text(coded(b"Content-Type: text/html; charset=cp1252", page.encode("cp1252"))) == "œuvre été"
    assert text(coded(b"A: b", b"<meta charset='iso-8859-15'>" + page.encode("iso-8859-15"))) == "œuvre été"
    assert text(coded(b"Content-Type: text/html; charset=none-such", raw)) == text(coded(b"Content-Type: text/html; charset=rot13", raw)) == "œuvre été"
    assert text(coded(b"A: b", page.encode("utf-16"))) == "œuvre été"
    meta = next(warc.parse(r[-1])[1].decode() for r in warc.derivatives(coded(b"Content-Encoding: gzip", gzip.compress(raw))) if r[0] == "metadata")
    assert "source-warc-ip-address: 192.0.2.1\r\n" in meta and "source-warc-record-id: <urn:x>\r\n" in meta and "http-header-content-encoding: gzip\r\n" in meta


def test_other_records_have_no_derivatives():
    assert warc.derivatives(b"") == warc.derivatives(b"no record\r\n\r\nx") == []
    assert warc.derivatives(warc.record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")) == []
    without = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 404 No\r\nA: b\r\n\r\n<p>gone")
    assert {r[0]: r[2] for r in warc.derivatives(without)} == {"metadata": "<urn:x>", "conversion": "<urn:x>"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/\r\nWARC-Type: x", ""), (3, "u", "<p>" + "w " * 200_000), (4, "u", "x"), (4, "u", "x"), (None, "u", "y")]
    df = spark.createDataFrame([(i, u, h, "a", "b") for i, u, h in rows], PAGES)
    got = warc.derive(warc.responses(df)).collect()
    assert len(got) == 12
    by = {(r.page_id, r.derived_kind): r for r in got}
    assert by[1, "conversion"].n_chars == 0 and by[1, "conversion"].target_uri == ""
    assert by[2, "metadata"].target_uri == "http://h/ WARC-Type: x"
    assert by[3, "conversion"].n_chars == len(("w " * 200_000).strip())
    assert len({r.record for r in got if r.page_id == 4}) == 2
    assert warc.derive(warc.responses(df.limit(0))).count() == 0


def test_query_against_a_reader_of_its_own(spark, tiny):
    """Records are taken apart with the email package and pages with html.parser; digests are made anew."""
    import base64
    import email
    import hashlib
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.lines, self.links = 0, [""], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "template", "noscript", "head")
            self.links += tag in ("a", "area") and any(k == "href" for k, _ in attrs)
            if tag in BREAKS:
                self.lines.append("")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "template", "noscript", "head")
            if tag in BREAKS:
                self.lines.append("")

        def handle_data(self, data):
            if not self.hidden:
                self.lines[-1] += data

    BREAKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav footer header aside blockquote pre hr form main".split())
    pages = {p.page_id: p for p in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    made = {(r.page_id, r.derived_kind): r for r in warc.derive(warc.responses(spark.read.parquet(f"{tiny}/pages.parquet"))).collect()}
    rows = {(r.page_id, r.derived_kind): r for r in warc.op5(spark, tiny).collect()}
    assert made.keys() == rows.keys() and len(rows) == 2 * len(pages)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for (i, kind), r in made.items():
        raw = bytes(r.record)
        version, _, rest = raw.partition(b"\r\n")
        head, _, block = rest.partition(b"\r\n\r\n")
        f = email.message_from_bytes(head + b"\r\n\r\n")
        reader = Reader()
        reader.feed(pages[i].html or "")
        reader.close()
        plain = "\n".join(x for x in (" ".join(y.split()) for y in reader.lines) if x)
        assert version == b"WARC/1.1" and block.endswith(b"\r\n\r\n") and int(f["Content-Length"]) == len(block) - 4
        assert f["WARC-Block-Digest"] == sha(block[:-4]) == r.block_digest and f["WARC-Source-Payload-Digest"] == sha((pages[i].html or "").encode())
        assert f["WARC-Refers-To"] == r.refers_to and f["WARC-Target-URI"] == pages[i].url and f["WARC-Concurrent-To"] == made[i, "conversion" if kind == "metadata" else "metadata"].record_id
        assert r.n_chars == len(plain) and r.n_links == reader.links
        if kind == "conversion":
            assert block[:-4].decode() == plain
        assert rows[i, kind].record_sha256 == hashlib.sha256(raw).hexdigest()


def test_files(spark, tmp_path):
    tricky = warc.response("t", "http://h/t", "<p>one\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\ntwo\r\n\r\nWARC/1.0\r\n</p>")
    binary = warc.record([("WARC-Type", "resource")], bytes(range(256)) * 50)
    records = [warc.response(str(i), f"http://h/{i}", HTML * (i + 1)) for i in range(5)] + [tricky, binary, warc.response("u", "", "")]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[3:]))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, f"file://{tmp_path}")
    assert sorted(bytes(r.record) for r in got.collect()) == sorted(records)
    assert warc.derive(got, "file").count() == 2 * 7

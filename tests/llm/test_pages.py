"""Operators on pages, and the corpus pipeline."""

import hashlib

from tests.llm import brute
from tests.oracle import DATA
from tidemark.llm import url_filter, warc
from tidemark.llm.common import shared_folder
from tidemark.llm.queries import URL_RULES


def test_rules_and_parts(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en", "http://a.example.com/en/1", "http://net/es/", "x://b.net/fr/#top", "https://host.org", "http://h?x/y", "http://com/" + "a/" * 50]
    rows = {r.url: r for r in url_filter.judge(spark.createDataFrame([(u, "own") for u in urls], "url string, rule string"), URL_RULES).collect()}
    got = {u: (r.host, r.path, r.rule, r.verdict) for u, r in rows.items()}
    assert got[None][:3] == got["no scheme"][:3] == ("", "", None)
    assert got[urls[2]] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[urls[3]][2:] == ("com/", "allow") and got[urls[4]][2:] == ("example.com/en/", "block")
    assert got[urls[5]][2:] == ("net/es/", "block") and got[urls[6]][:3] == ("b.net", "/fr/", "net/fr/")
    assert got[urls[7]][:3] == ("host.org", "", None) and got[urls[8]][:2] == ("h", "") and got[urls[9]][2] == "com/"
    assert url_filter.judge(spark.createDataFrame([], "url string"), URL_RULES).count() == 0


def test_variable_segments_become_wildcards_and_bad_templates_go(spark):
    rules = [url_filter.UrlRule("block", f"h.org/spam/{c}") for c in "abcde"] + [url_filter.UrlRule("allow", f"h.org/good/{c}") for c in "abcde"]
    urls = [f"http://h.org/{kind}/{c}{word}" for kind in ("spam", "good") for c in "abcdefghij" for word in ("one", "two", "three", "four", "five", "six")]
    rows = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    assert {r.template for r in rows} == {"/spam/*", "/good/*"}
    assert {(r.path.split("/")[1], r.verdict) for r in rows if r.rule is None} == {("spam", "block"), ("good", "allow")}


def test_pages_without_evidence_stay(spark):
    pairs = [(h, c) for h in ("a.net", "b.net") for c in ("es", "fr", "en", "de")] + [("c.org", c) for c in ("en", "de")] + [("example.com", "en")]
    urls = [f"http://{h}/{c}/{k}/page" for h, c in pairs for k in range(6)]
    rows = url_filter.judge(spark.createDataFrame([(u, "own") for u in urls], "url string, __none string"), URL_RULES).collect()
    got = {(r.host, r.path.split("/")[1]): (r.verdict, r.template.split("/")[1]) for r in rows}
    for host in ("a.net", "b.net"):
        assert got[host, "es"] == got[host, "fr"] == ("block", "~es")
        assert got[host, "en"] == ("allow", "en") and got[host, "de"] == ("allow", "de")
    assert got["c.org", "en"] == ("allow", "en") and got["c.org", "de"] == ("allow", "de")
    # Every rule blocks here, so the overall share alone would block a host without labels.
    assert all(r.rule is not None for r in rows if r.verdict == "block")


def test_branches_that_differ_from_all_others_together(spark):
    """Of four branches two are blocked and two allowed: each two merge, though both differ from the pool; one without enough labels doesn't."""
    rules = [url_filter.UrlRule("block", "h.org/a/"), url_filter.UrlRule("block", "h.org/b/"), url_filter.UrlRule("allow", "h.org/c/"), url_filter.UrlRule("allow", "h.org/d/"), url_filter.UrlRule("block", "h.org/e/")]
    urls = [f"http://h.org/{c}/{w}" for c in "abcd" for w in ("one", "two", "three", "four", "five", "six")] + ["http://h.org/e/one", "http://h.org/e/two", "http://h.org/f"]
    rows = url_filter.judge(spark.createDataFrame([(u, "own", 1.0) for u in urls], "url string, template string, purity double"), rules).collect()
    assert {(r.path.split("/")[1], r.template.split("/")[1]) for r in rows} == {("a", "~a"), ("b", "~a"), ("c", "~c"), ("d", "~c"), ("e", "e"), ("f", "f")}


def test_deep_paths_and_repeated_rows_against_sql(spark, tmp_path):
    import random

    from tests.oracle import assert_same
    from tidemark.llm import oracle

    r = random.Random(8)
    urls = [None, "", "x", "http://", "http:///a", "http://trap.net/" + "es/" * 60, "http://trap.net/" + "es/" * 61, "http://trap.net/" + "/".join(map(str, range(40)))]
    for host in ("a.com", "b.net", "c.org", "Deep.Example.com", "e..net", ".net"):
        urls += [f"http://{host}/" + "/".join(r.choice(("es", "fr", "en", "p1", "p22", "x")) for _ in range(r.choice((1, 2, 3, 4, 25)))) for _ in range(20)]
        urls += [f"https://{host}/{r.choice(('es', 'fr', 'en'))}/{r.choice('abcdefghij')}{r.choice('klmnop')}/{k}?q" for k in range(80)]
    rows = [(i, u) for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    got = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).withColumn("purity", url_filter.F.round("purity", 6)).drop("url")
    assert_same(got, oracle.url_filter(URL_RULES), str(tmp_path))
    assert got.where("length(template) > 100").count() == 4


def test_archives_round_trip(spark):
    long, other = "x" * 2000, "\x00\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/", long), (2, None, long), (3, "u\nv", "é" * 700), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (7, "u", "é" * 700), (7, "u", other), (8, "u", "y" * 999)]
    folder = shared_folder(spark)
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{folder}/m", records_per_file=3)
    archives = warc.normalise(spark, f"{folder}/m", f"{folder}/n")
    assert archives.count() > 1 and sum(r.n_records for r in archives.collect()) == len(rows)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read(archives).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    target = {sha(long): 2, sha("é" * 700): 7}
    want = []
    for page, _, html in rows:
        to = target.get(sha(html))
        revisit = to is not None and to != page
        want.append((page or 0, len((html or "").encode()), sha(html), "revisit" if revisit else "response", to if revisit else 0))
    assert got == sorted(want)
    texts = {bytes(r.payload) for r in warc.read(archives).where("record_type = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h in rows}


def test_members_stand_alone(spark):
    """Each sidecar entry names one gzip member with one record."""
    import gzip
    import os

    folder = shared_folder(spark)
    warc.write(spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id bigint, url string, html string").coalesce(1), f"{folder}/m")
    archive = warc.normalise(spark, f"{folder}/m", f"{folder}/n").first().archive.removeprefix("file://")
    data = open(archive, "rb").read()
    entries = [x.split("\t") for x in open(f"{archive}.idx").read().splitlines()]
    assert [int(o) for o, _, _ in entries] == [0, *[int(o) + int(n) for o, n, _ in entries][:-1]] and int(entries[-1][0]) + int(entries[-1][1]) == os.path.getsize(archive)
    for o, n, ident in entries:
        record = gzip.decompress(data[int(o) : int(o) + int(n)])
        page = ident.removeprefix("<urn:page:").removesuffix(">")
        assert record.count(b"WARC/1.1") == 1 and record.endswith(f"page {page}\r\n\r\n".encode())


def test_foreign_archives(spark, tmp_path):
    """Several members and padding, names in lower case, folded lines, other HTTP heads, base 32 digests, other record types, bare line feeds."""
    import base64
    import gzip

    page, other = b"<html>\r\n\r\nWARC/1.0\r\n</html>", b"z" * 3_000_000
    def http(body, head=b"HTTP/1.0 200 Fine\r\nx-a: 1\r\nServer: s\r\n\r\n"):
        return head + body

    def record(kind, ident, block, *lines, end="\r\n"):
        head = ["WARC/1.0", f"warc-type:{kind}", f"WARC-RECORD-ID: <urn:uuid:{ident}>", *lines, f"content-length: {len(block)}"]
        return (end.join(head) + end * 2).encode() + block + b"\r\n\r\n"

    sha = base64.b32encode(hashlib.sha1(page).digest()).decode()
    kind = "content-type: application/http;msgtype=response"
    parts = [
        record("warcinfo", 1, b"software: x\r\n"),
        record("response", 2, http(page), kind, "warc-target-uri: http://a/\r\n  b", f"WARC-Payload-Digest: sha1:{sha}"),
        record("response", 3, http(other, b"HTTP/1.1 200\n\n"), kind, end="\n") + record("revisit", 4, b"HTTP/1.1 200 OK\r\n\r\n", kind, f"Warc-Payload-Digest: SHA1:{sha}", "warc-refers-to: <urn:uuid:2>"),
        record("resource", 5, b""),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/own.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) + b"\0" * 512)
    (tmp_path / "in/one stream.gz").write_bytes(gzip.compress(b"".join(parts)))
    done = warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.archive.rsplit("/", 1)[1]: r.n_records for r in done.collect()} == {"own.warc.gz": 5, "one%20stream.warc.gz": 5}
    want = [
        ("<urn:uuid:1>", None, "warcinfo", 13, hashlib.sha1(b"software: x\r\n").hexdigest(), None),
        ("<urn:uuid:2>", None, "response", len(page), hashlib.sha1(page).hexdigest(), "http://a/ b"),
        ("<urn:uuid:3>", None, "response", len(other), hashlib.sha1(other).hexdigest(), None),
        ("<urn:uuid:4>", "<urn:uuid:2>", "revisit", None, hashlib.sha1(page).hexdigest(), None),
        ("<urn:uuid:5>", None, "resource", 0, hashlib.sha1(b"").hexdigest(), None),
    ]
    rows = warc.read(done).collect()
    assert sorted(((r.record_id, r.refers_to_id, r.record_type, r.payload_bytes, r.payload_digest, r.url) for r in rows), key=repr) == sorted(want * 2, key=repr)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {page, other} and all(r.page_id is None for r in rows)


def test_broken_archives_are_errors():
    import gzip
    import io

    import pytest

    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    read = lambda data: [(f, b"".join(p)) for f, p in warc.split_records(warc._inflated(io.BytesIO(data)))]
    assert read(gzip.compress(whole * 3)) == [({"content-length": "5"}, whole)] * 3 and read(b"") == []
    for data in (gzip.compress(whole[:-8]), gzip.compress(whole[:20]), gzip.compress(whole)[:-9], gzip.compress(b"HTTP" + whole)):
        with pytest.raises(ValueError):
            read(data)


def test_payloads_of_pages_with_clashing_columns(spark):
    folder = shared_folder(spark)
    warc.write(spark.createDataFrame([(1, "u", "p", "x", 5)], "page_id bigint, url string, html string, payload_digest string, target bigint"), f"{folder}/m")
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in warc.read(warc.normalise(spark, f"{folder}/m", f"{folder}/n")).collect()] == [(1, 1, "response")]


def test_no_pages(spark):
    folder = shared_folder(spark)
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{folder}/m")
    assert warc.read(warc.normalise(spark, f"{folder}/m", f"{folder}/n")).count() == 0


def test_pipeline_is_its_stages(spark):
    """The whole pipeline against brute force, from the rules' verdict on."""
    import sentencepiece

    import corpus_pipeline
    from tidemark.llm import quality_rules
    from tidemark.llm.queries import TOKENIZER

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality_rules.judge(docs).where("kept").collect()}
    texts = {i: t for i, (_, _, t) in brute.lines(list(kept.items())).items()}
    texts = {i: texts[i] for i, (_, c) in brute.groups(list(texts.items())).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    judged = brute.contaminated(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not (judged[i][1] > 0 and 20 * judged[i][1] >= judged[i][0])}
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows) and 0 < len(rows) < docs.count()


def test_pipeline_on_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    prose = lambda k, n=30: " ".join(f"the {w}{k}x{j} of" for j, w in enumerate(("house", "river", "stone", "cloud") * 9))[: n * 12]
    leaked = " ".join(f"bench{k} the" for k in range(20))
    rows = [
        (1, prose(1)), (2, None), (3, ""), (4, prose(1)), (5, prose(5)), (5, prose(5)), (6, leaked + " " + prose(6, 8)), (7, "a few words"),
        (None, prose(8)), (None, leaked), (9, prose(9) + "\n" + "this line is shared by two of them and long"), (10, "This line is shared by two of them and long "), (11, prose(11, 5) * 200),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), -1, -2, "k", "t") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, n_lines int, n_dropped int, kept string, tag string")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.written(stage(spark, table, str(tmp_path)))
        assert table.columns == docs.columns and {(r.n_lines, r.n_dropped, r.kept, r.tag) for r in table.collect()} == {(-1, -2, "k", "t")}
    assert sorted((r.doc_id or 0, r.n_chars == len(r.text)) for r in table.collect()) == [(0, True), (1, True), (4, True), (5, True), (5, True), (9, True), (10, True)]
    assert [r.text for r in table.where("doc_id in (4, 10)").collect()] == ["", ""]
    none = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0

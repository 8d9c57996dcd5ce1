"""Quality, packing, HTML, archives and the pipeline."""

import glob
import gzip
import hashlib
import os
import random
import time
import uuid
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import naive_score
from tokenizers import Tokenizer
from vesselwatch.llm import archives
from vesselwatch.llm.html import best_path, extract, main_text, path_number
from vesselwatch.llm.packing import Packer, pack_documents
from vesselwatch.llm.quality import ByteNet, chunks, is_held_out, score_quality, train

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def test_quality_separates_and_reads_whole_texts(spark):
    rng = random.Random(1)
    good = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma.", "Delta", "of"]) for _ in range(n))
    rows = [(k, good(60) if k % 4 else "".join(w + "%%% " for w in good(60).split()), int(bool(k % 4))) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    net = train(docs, labels, epochs=4)
    got = {r["doc_id"]: r for r in score_quality(docs, net).withColumn("held", is_held_out(F.col("doc_id"))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {k for k in got if got[k]["held"]} == {r[0] for r in held}
    assert np.mean([(got[r[0]]["score"] >= 0.3) == r[2] for r in held]) > 0.95
    odd = score_quality(spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, good(20000))], "doc_id long, text string"), net).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    assert {r["score"] for r in score_quality(docs.limit(3), None).collect()} == {0.5}
    assert train(docs.limit(0), labels) is None


def test_chunks_cover_every_byte():
    for n in (0, 1, 5, 8, 9, 13, 511, 512, 513, 1000, 5000):
        data, windows, starts, firsts = chunks([b"x" * n, b"ab"])
        seen = np.zeros(len(data) + 16, int)
        for w in windows[: starts[firsts[1]]]:
            seen[w : w + 8] += 1
        assert (seen[:n] > 0).all() and len(firsts) == 2
    assert len(ByteNet().scores([b"", b"a" * 3000])) == 2


def test_scores_equal_a_naive_convolution():
    rng = random.Random(4)
    net = ByteNet()
    net.offset = np.float32(0.2)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 12, 13, 100, 479, 480, 511, 512, 513, 544, 545, 1000, 3001)]
    assert np.allclose(net.scores(texts), [naive_score(net, t) for t in texts], atol=1e-5)
    assert np.allclose(net.scores(texts), np.concatenate([net.scores([t]) for t in texts]), atol=1e-6)


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"{k} " + "word " * 2000) for k in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    nets = [train(docs, labels, epochs=1, sample_bytes=n) for n in (50_000, 10**9)]
    assert not np.allclose(nets[0].filters, nets[1].filters)
    scored = score_quality(docs.withColumn("score", F.lit("x")), nets[0])
    assert scored.schema["score"].dataType.simpleString() == "double" and scored.count() == 120
    assert scored.groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
    assert score_quality(docs.limit(0), nets[0]).count() == 0


def _check_packing(rows, pieces, size=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {k: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for k, x in rows}
    at, sequences = defaultdict(int), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = tokens[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["length"] > 0 and p["doc_tokens"] == len(ids)
        assert bytes(p["ids"]) == ids[p["start"] : p["start"] + p["length"]].tobytes()
        at[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert dict(at) == {k: len(v) for k, v in tokens.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == size or end & (end - 1) == 0


def test_packing(spark):
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|> it's", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>\n y<|endoftext", "<|endoftext|>", "<|ENDOFTEXT|>  ", " \n\t  x  y", "日本 é́  z", "a\x1cb\x85c\xa0 d", "x" * 5000, "word " * 30000]
    texts += [" ".join(rng.choice(["Erinst", "resh", "été", "42", "don't", "***", "\n"]) for _ in range(rng.randrange(1500))) for _ in range(120)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _check_packing(rows, pack_documents(df, TOKENIZER).collect())
    assert pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_packer_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer = Packer(64)
    for k in range(500):
        before, n = packer.level.copy(), rng.randrange(1, 64)
        costs = {}
        for fill in [0, *np.flatnonzero(before[:64]).tolist()]:
            if fill + n <= 64:
                after = before.copy()
                after[fill] -= fill > 0
                after[fill + n] += fill + n < 64
                costs[fill] = int((after[1:64].astype(int) ** 2).sum())
        list(packer.add(k, np.arange(n, dtype="<u4")))
        now = int((packer.level[1:64] ** 2).sum())
        assert now == min(costs.values())


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a="</p><p>no";</script></head><body><!-- no <p> --><header>No</header><nav><a href=x>No</a></nav>
<div class="cookie-notice">No</div><div id=ad1>No</div><main><article class="post p123"><h1>One &amp; two</h1><p>Three<b>four</b> <a href="x>y">five</a>&nbsp;six<br>seven<p>A < b &lt;i&gt;
<form><p>No</p></form><aside>No</aside><ul><li>Eight<li>nine</ul><div class="Comments"><p>No, a long comment of many more words than the article itself has, which it isn't.</p></div></article></main><footer>No</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, ""), (4, "http://h.x/4", "<p>cut <b>off &am"), (5, "http://h.x/5", PAGE[: PAGE.index("nine") + 2]), (None, "u", "text only"), (6, "x", "<script>no"), (7, "x", "a <foot")]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x"))).collect()}
    assert got[1]["text"] == "One & two Threefour five six seven A < b <i> Eight nine"
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[3]["n_chars"] == 0
    assert got[5]["text"] == "One & two Threefour five six seven A < b <i> Eight ni" and got[6]["text"] == ""
    assert got[4]["url"] == "http://h.x/4"
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_host_decides(spark):
    usual = '<body><div class="c{0}"><p>Many words of the article are here, and more.</p></div><div class="rail"><p>Short.</p></div></body>'
    odd = '<body><div class="c9"><p>Few words.</p></div><div class="rail"><p>This time the rail is by far the longer one of the two.</p></div></body>'
    rows = [(k, "http://h.x/", usual.format(k)) for k in range(5)] + [(9, "http://h.x/", odd), (10, "http://other.x/", odd)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Few words." and got[10].startswith("This time")
    assert best_path(usual.format(1)) == path_number("div.c", path_number("body"))


LONG = "Many words of the article are here, and there are more of them than anywhere else."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><p>text</p><p>more</p>", "text more"), ("text only", "text only"), ("<p>cut <b>off &am", "cut off &am"),
        (f"<body><div id=content><h1>T</h1><div class=text>{LONG}</div></div></body>", f"T {LONG}"), (f"<body><h1>T</h1><div class=text>{LONG}</div></body>", f"T {LONG}"),
        (f"<body><div class=post><div class=lead>Lead.</div><div class=body>{LONG}</div><div class=more>End.</div></div><div class=rail>x</div></body>", f"Lead. {LONG} End."),
        (f"<body><div class=wrap><ul><li><a href=x>One link</a><li><a href=x>Two links</a></ul><div class=text>{LONG}</div></div></body>", LONG),
    ],
)
def test_text_beside_the_best_container(html, want):
    assert extract(html, best_path(html)) == want


@pytest.mark.parametrize("tag", ["div", "section", "article"])
@pytest.mark.parametrize("words", [(40, 40), (20, 90), (12, 60, 25)])
def test_unequal_parts_of_the_body_stay_in_order(tag, words):
    """Parts side by side with classes of their own; a list of links between them and a marked part go."""
    texts = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate(words)]
    parts = [f"<{tag} class=part{chr(97 + k)}><p>{t}</p></{tag}>" for k, t in enumerate(texts)]
    links = "<div class=x><a href=1>A long text of a link to elsewhere</a> <a href=2>Another long text of a link</a></div>"
    html = f"<body><nav>No</nav>{links.join(parts)}<div class=sidebar><p>{texts[0]}</p></div></body>"
    assert extract(html, best_path(html)) == " ".join(texts)


def test_deep_marks_are_told_apart():
    inner = f"<p>{LONG}</p>"
    for _ in range(40):
        inner = f"<div class=widget>Side note.{inner}</div>"
    html = f"<body><div class=wrap>{LONG * 30}{inner}</div></body>"
    assert "Side note" not in extract(html, best_path(html)) and extract(html, best_path(html)).startswith(LONG)
    started = time.monotonic()
    assert best_path("<div class=ad>x" * 20_000) is not None
    assert time.monotonic() - started < 10


@pytest.mark.parametrize("mark", ["has-sidebar", "no-sidebar", "ad-free", "social-science", "comment-open", "with-header", "notice-board", "header"])
@pytest.mark.parametrize("tag", ["div", "main", "article"])
def test_marks_of_the_whole_page(mark, tag):
    html = f"<body><nav>No</nav><{tag} class='{mark}'><p>{LONG}</p></{tag}></body>"
    assert extract(html, best_path(html)) == LONG


@pytest.mark.parametrize("mark", ["sidebar", "ad1", "cookie-notice", "nav-left", "commentList", "site_footer", "mainNav", "share-links"])
def test_marked_parts_go_unless_nothing_else_is_left(mark):
    part = f"<div class='x {mark}'><p>Some other words.</p></div>"
    html = f"<body><div class=wrap><div class=text>{LONG}</div>{part}</div></body>"
    assert extract(html, best_path(html)) == LONG
    assert extract(part, best_path(part)) == "Some other words."
    assert extract(f"<p>{LONG} <span class={mark}>No</span> end", 0) == f"{LONG} end"


class _Article(HTMLParser):
    """The text of article elements by the standard library's parser: any block tag is a break."""

    INLINE = ("a", "b", "i", "em", "span")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts += [] if tag in self.INLINE else [" "]

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts += [] if tag in self.INLINE else [" "]

    def handle_data(self, data):
        self.parts += [data] if self.depth else []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pages_equal_a_naive_extractor(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.collect()
    got = {r["page_id"]: r for r in main_text(pages.union(pages.limit(3))).collect()}
    assert rows and set(got) == {r["page_id"] for r in rows}
    for r in rows:
        parser = _Article()
        parser.feed(r["html"])
        parser.close()
        text = " ".join("".join(parser.parts).split())
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 100_000 + LONG, "<div class=a><p>" * 100_000 + LONG + "</x>" * 100_000, "<p><td>" + "<div>" * 100_000 + f"<p>{LONG}", "<table>" * 50_000 + "<tr><td>" * 50_000 + LONG,
        "<article>" + "<section><p>x</p>" * 50_000 + LONG, "<li>" * 100_000 + LONG, "<a '>" * 100_000 + LONG, "<a " * 100_000 + ">" + LONG, "<!-- " * 100_000 + "-->" + LONG, "<div class=ad><span class=nav>" * 50_000 + LONG, f"<p>{LONG}</p>" * 50_000,
    ],
    ids=range(11),
)
def test_nested_and_repeated_tags_end_soon(html):
    started = time.time()
    text = extract(html, best_path(html))
    assert time.time() - started < 20 and text.endswith(LONG)


def test_math_stays():
    html = f"<body><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><noscript>No</noscript></body>"
    assert extract(html, best_path(html)) == f"{LONG} x=2 holds."


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/b c\n", "20010203040506", "text/html", b"x\r\n\r\nfiledesc://not a header 1 2 3\n"), ("", "20010203040506", "text/html", b"")]
    back = list(archives.read_arc(archives.write_arc(version, records)))
    assert [(r["url"], r["date"], r["block"]) for r in back] == [("http://a/b%20c%0A", "20010203040506", records[0][3]), ("-", "20010203040506", b"")]
    assert list(archives.read_arc(gzip.compress(archives.write_arc(version, records)))) == back
    with pytest.raises(ValueError, match="ends within"):
        list(archives.read_arc(archives.write_arc(version, records)[:-20] if version == 2 else archives.write_arc(version, records[:1])[:-5]))


@pytest.mark.parametrize("number", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_identifiers_carry_numbers(number):
    assert archives.uuid_number(archives.record_uuid(number)) == number


@pytest.mark.parametrize("small", [True, False])
def test_archives(spark, monkeypatch, small):
    monkeypatch.setattr(archives, "small_enough", lambda *_: small)
    long = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 100_000
    rows = [(5, "u", "x" * 100), (3, "http://h/ ü", "x" * 100), (4, None, "y" * 99), (2, "u", "y" * 99), (9, "u", None), (8, "u", ""), (7, "u", long), (1, "u", long), (None, "u", long), (3, "u", "x" * 100), (-6, "u", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.archive_pages(df).collect()), key=str)
    first = {"x" * 100: 3, long: 1}
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if k is not None and first.get(h) not in (None, k) else None
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    assert archives.archive_pages(df.limit(0)).count() == 0


FOREIGN = [
    "filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n",
    "\nhttp://www.example.org/a b.html 192.0.2.1 19961104142103 text/html {0}\nHTTP/1.0 200 Document follows\nContent-type: text/html\n\n{1}",
    "\nhttp://www.example.org/again 192.0.2.1 199611041421 text/html {0}\r\nHTTP/1.0 200 Document follows\nContent-type: text/html\n\n{1}",
    "\ndns:www.example.org 192.0.2.9 19961104142000 text/dns 9\n192.0.2.1\n\n\n", "ftp://example.org/x 192.0.2.1 19961104142000 text/plain 2\nhi",
]


def test_foreign_archives_are_converted(spark, tmp_path):
    page = "<p>" + "words " * 40 + "</p>"
    size = len("HTTP/1.0 200 Document follows\nContent-type: text/html\n\n") + len(page)
    head = FOREIGN[0].split("\n", 1)[1]
    data = ("".join([FOREIGN[0].replace(" 76\n", f" {len(head)}\n"), *FOREIGN[1:]])).format(size, page).encode()
    arcs = spark.createDataFrame([("one.arc", data), ("two.arc.gz", gzip.compress(data[:-2] + b"ho"))], "name string, archive binary").withColumn("url", F.lit(1))
    archives.arc_to_warc(arcs, str(tmp_path / "warc"))
    rows = archives.read_warc_files(spark, str(tmp_path / "warc")).collect()
    assert len(rows) == 8 and len({r["number"] for r in rows}) == 8
    first = min((r for r in rows if "example.org/a" in r["target_uri"]), key=lambda r: r["number"])
    for r in rows:
        if r["target_uri"].startswith("http://"):
            assert r["payload_digest"] == hashlib.sha256(page.encode()).hexdigest() and r["target_uri"] in ("http://www.example.org/a b.html", "http://www.example.org/again")
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["number"] == first["number"] else ("revisit", first["number"]))
        else:
            assert r["record_type"] == ("response" if r["target_uri"].startswith("dns:") else "resource")
    assert {r["date"] for r in rows if r["target_uri"].endswith("again")} == {"1996-11-04T14:21:00Z"}
    assert len({r["payload_digest"] for r in rows if r["target_uri"].startswith("ftp")}) == 2
    # the files are plain WARC to any reader of gzip
    found = [h for f in glob.glob(str(tmp_path / "warc/part-*")) for h, _ in archives.read_warc(gzip.open(f))]
    assert len(found) == 8 and all(uuid.UUID(h["warc-record-id"][10:-1]) for h in found)


def test_payloads_that_hold_the_separator(spark, tmp_path):
    """Bytes that can't be compressed around empty gzip members, which separate records in a file."""
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(0, 256, n, np.uint8).tobytes()
    blocks = [noise(200_000) + archives.SEPARATOR + noise(200_000), archives.SEPARATOR * 3 + noise(300) + archives.SEPARATOR[:9] + archives.SEPARATOR, noise(70_000) + archives.SEPARATOR[:-1]]
    for block in blocks:
        member = archives._member(block)
        assert (member + archives.SEPARATOR).index(archives.SEPARATOR) == len(member) and gzip.decompress(member) == block
    arcs = spark.createDataFrame([("a.arc", archives.write_arc(1, [(f"http://x/{k}", "20010101000000", "image/x", b) for k, b in enumerate(blocks)]))], "name string, archive binary")
    archives.arc_to_warc(arcs, str(tmp_path / "warc"))
    rows = archives.read_warc_files(spark, str(tmp_path / "warc")).collect()
    assert sorted(r["payload_digest"] for r in rows) == sorted(hashlib.sha256(b).hexdigest() for b in blocks)


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "warc")
    archives.archive_pages(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string").coalesce(1), path).collect()
    file = max(glob.glob(path + "/part-*"), key=os.path.getsize)
    data = bytearray(open(file, "rb").read())
    data[60] ^= 255
    open(file, "wb").write(data)
    for crc in glob.glob(path + "/.part-*.crc"):
        os.remove(crc)
    with pytest.raises(Exception, match="damaged|not a record"):
        archives.read_warc_files(spark, path).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).union(spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0)], docs.schema))
    now = docs.union(extra).withColumn("cls", F.lit("mine"))
    kept = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(now.count())
        assert now.columns == [*docs.columns, "cls"], name
    assert kept[0] > kept[1] > kept[2] == kept[3] > 100
    pieces = corpus_pipeline.pack(spark, now, SF)
    assert pieces.select("doc_id").distinct().count() == kept[3]
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_repeated_ids_lose_no_text(spark):
    import corpus_pipeline

    rng = random.Random(9)
    text = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(60)) for _ in range(4)]
    rows = [(5, text[0]), (5, text[1]), (3, text[0]), (3, text[2]), (3, text[2]), (7, text[1] + " x"), (None, text[0]), (8, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("__row", F.lit(2))
    got = corpus_pipeline.drop_near_copies(spark, df.repartition(3), SF)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, text[1]), (3, text[0]), (3, text[2]), (None, text[0]), (8, None), (9, ""), (9, "")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), SF).count() == 0

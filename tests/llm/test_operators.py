"""Each operator against brute force, on awkward small tables and on the smallest driver tables."""

import base64
import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import bpe, components, embedding_join, encoders, html_extract, huffman, line_dedup, minhash, mixing, nbsvm, quality_rules, token_counts, token_store
from graphloom.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, digest string, copies string"

AWKWARD = [
    (0, "plain words, here. And more\nlines  with   runs \t of space \n b", "s0"),
    (1, None, "s0"),
    (2, "", None),
    (3, "a<|endoftext|> b <|endoftext|>c don't we'll it's 12345 67 don’t", "s1"),
    (4, "x  y z ​ q\x1c r\x00 s\u0085 t", "s1"),
    (5, "\n\n \n  leading\n\n\nand trailing   \n", "s1"),
    (6, "naïve façade straße 日本語 テキスト 🙂🙂 é̀", "s2"),
    (7, "word " * 3000, "s2"),
    (8, "plain words, here. And more\nlines  with   runs \t of space \n b", "s0"),
    (None, "no id at all, but still some text to encode", "s3"),
    (9, "one two", "s3"),
    (9, "one two", "s3"),
    (10, "!!! ... ,, .. a.b,c. d, e.", "s3"),
    (11, "abc" * 40000, "s4"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


# 1, 4: tokenizers


def test_units_join_and_encode_as_the_whole(real):
    encode, plain = encoders.JsonEncoder(encoders.read_vocabulary(P.path("byte_bpe_50k.json"))), library()
    for text in [t for _, t, _ in AWKWARD if t] + [r.text for r in real.limit(60).collect()]:
        assert "".join(encoders.safe_units(text)) == text == "".join(encoders.safe_pieces(text, 50))
        assert list(np.frombuffer(encode(text), dtype="<u4")) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (3, 2), (300, 9), (5000, 16)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 2).astype(np.int64))
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= max(limit, math.ceil(math.log2(n)) if n > 1 else 1)
    assert n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1.0
    book = huffman.Codebook(lengths)
    for size in (0, 1, 255, 256, 257, 4000):
        ids = rng.integers(0, n, size).astype(np.uint32)
        assert (book.decode(*(lambda p, c: (p, size, c))(*book.encode(ids))) == ids).all()


def test_huffman_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(3).integers(1, 50, 40)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts, 30)).sum()) == total


@pytest.mark.parametrize("which,block", [("awkward", 64), ("real", 1 << 14)])
def test_token_store(spark, request, which, block):
    docs = request.getfixturevalue(which)
    path = Scratch(spark, "test").path("store")
    token_store.write_token_store(docs, path, P.path("byte_bpe_50k.json"), block_ids=block)
    found = token_store.read_token_store(spark, path).collect()
    plain, start = library(), 0
    rows = in_order([(r.doc_id, r.text or "") for r in docs.collect()])
    assert len(found) == len(rows)
    by = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in by] == [i for i, _ in rows]
    for r, (_, text) in zip(by, rows):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(packed), packed)
        start += len(ids)


def test_token_store_empty(spark, awkward):
    path = Scratch(spark, "test").path("store")
    token_store.write_token_store(awkward.limit(0), path, P.path("byte_bpe_50k.json"))
    assert token_store.read_token_store(spark, path).count() == 0


@pytest.mark.parametrize("which", ["awkward", "real"])
def test_bpe(request, which):
    import tiktoken

    docs = request.getfixturevalue(which)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    expected = []
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        expected.append((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in found.collect())
    back = bpe.decode_documents(found, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert collections.Counter(bytes(r.decoded) for r in back) == collections.Counter((r.text or "").encode() for r in docs.collect())
    assert bpe.encode_documents(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_of_long_white_space(spark):
    encoder = encoders.RankEncoder(encoders.read_vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert encoder.leaves_last
    texts = [f"start {unit * (1_500_000 // len(unit))}end of it" for unit in (" ", "\t", "\n", " \t\n", "\xa0", "ab", "7", "!?")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=False).collect()}
    assert [found[k].decoded_sha256 for k in range(len(texts))] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_white_space_is_cut_as_the_library_does(monkeypatch):
    encoder = encoders.RankEncoder(encoders.read_vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    monkeypatch.setattr(encoders, "_AT_ONCE", 32)
    rng = np.random.default_rng(3)
    parts = [" ", "\n", "\t", "\r\n", "\xa0", "\u2003", "\u200b", "word", "x", "12", "!?", "é", "'s"]
    for _ in range(200):
        text = "".join(parts[int(k)] * int(n) for k, n in zip(rng.integers(0, len(parts), 30), rng.integers(1, 30, 30)))
        assert encoder(text) == encoder.encoding.encode_ordinary(text)


@pytest.mark.parametrize("which,name", [("awkward", "byte_bpe_50k.json"), ("real", "byte_bpe_50k.json"), ("awkward", "word_bpe_49k.json"), ("awkward", "piece_bpe_32k.model")])
def test_token_counts(request, which, name, monkeypatch):
    monkeypatch.setattr(token_counts, "COMMON", 40)
    docs = request.getfixturevalue(which)
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(p.encode(t))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    expected = [(r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 512) for r in docs.collect()]
    found = [tuple(r) for r in token_counts.count_tokens(docs, P.path(name)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


# 3: embeddings


def brute_vectors(rows, least=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    links, parent = collections.Counter(), {k: k for k in range(len(rows))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(good)
    for a in keys:
        for b in keys:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root(k)] = min(low.get(root(k), r[0]), r[0])
    return [(r[0], links[k], low.get(root(k)), r[0] is None or low[root(k)] == r[0]) for k, r in enumerate(rows)]


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "UNIT", 16)
    monkeypatch.setattr(embedding_join, "GROUP", 2)
    monkeypatch.setattr(embedding_join, "LEAF", 5)
    monkeypatch.setattr(embedding_join, "CHUNK", 2)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        base = rng.normal(size=6)
        for _ in range(int(rng.integers(1, 4))):
            rows.append((len(rows), (base + 0.2 * rng.normal(size=6)).tolist(), int(k % 3)))
    rows += [(len(rows) + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1) for k in range(40)]
    n = len(rows)
    rows += [(n - 1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.5], 2), (0, [-1.0, 2.0, -3.0, 4.0, -5.0, 6.0], 0), (n, None, 1), (n + 1, [0.0] * 6, 1), (n + 2, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (n + 3, [float("nan")] * 6, 1), (n + 4, [1.0] * 6, None), (None, [1.0] * 6, 1), (n + 5, [], 1), (n + 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 2), (n + 7, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0], 1), (n + 8, [1.0, 2.0], 1), (n + 9, [1.0, 2.0], 1)]
    found = embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute_vectors(rows)))
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embedding_join_on_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(tuple(r) for r in embedding_join.near_vectors(table).collect()) == sorted(brute_vectors(rows))


# 5: quality rules


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if grams[tuple(words[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("which", ["awkward", "real"])
def test_quality_rules(request, which, monkeypatch):
    docs = request.getfixturevalue(which)
    found = quality_rules.judge(docs).collect()
    hosts = collections.defaultdict(lambda: [0, 0])
    for r in found:
        got = tuple(r[f"_rule_{n}"] for n in quality_rules.FEATURES)
        assert got == brute_rules(r.text)
        assert r._rule_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        hosts[r.source][0] += 1
        hosts[r.source][1] += r._rule_failed
    mean = sum(f for _, f in hosts.values()) / sum(n for n, _ in hosts.values())
    spread = np.var([f / n for n, f in hosts.values()])
    weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else 1000.0
    for r in found:
        n, f = hosts[r.source]
        assert r._rule_kept == (not r._rule_failed and (f + mean * weight) / (n + weight) <= 0.5)
    columns = ["doc_id", *(f"_rule_{n}" for n in quality_rules.FEATURES), "_rule_failed", "_rule_kept"]
    for sent in (quality_rules.SENT_HOSTS, -1):
        monkeypatch.setattr(quality_rules, "SENT_HOSTS", sent)
        slim = quality_rules.judge_counts(docs).collect()
        assert sorted(str([r[c] for c in columns]) for r in slim) == sorted(str([r[c] for c in columns]) for r in found)
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r._rule_kept for r in found)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_bad_host_goes(spark):
    rows = [(k, "x", "bad") for k in range(50)] + [(50, "a clean text of more than ten words which is fine by itself", "bad")]
    rows += [(100 + k, f"a clean text of more than ten words number {k} is fine by itself", f"good{k % 3}") for k in range(60)]
    kept = {r.doc_id for r in quality_rules.apply_rules(table(spark, rows)).collect()}
    assert kept == set(range(100, 160))


# 6: pages


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="page">
    <header><a href="/">Home</a> Site name</header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site and you agree that the use of them is fine with all of us.</div><!-- <p>no</p> -->
    <article><h1>A&nbsp;title &amp; more</h1><p>First <b>bold</b>
      text<p>Short.<div class="ad">Buy the best of the things that you will ever have in the house or in the garden.</div>
    <p>The last paragraph of the text is long enough to be one that the rules keep by their own. &copy;</p>
    <form><input><p>Subscribe to the letter</p></form><section id="comments"><p>I think that this is the best of all the texts that I have read.</p></section></article>
    <aside>Related</aside><footer>&copy; x</footer></body>"""
    assert html_extract.main_text(page) == "A title & more\nFirst bold text\nShort.\nThe last paragraph of the text is long enough to be one that the rules keep by their own. ©"
    for broken in ("", "<", "<p", "<p>&am", "<div class='ad", "<!-- x", "<script>", "a < b", "</p></div>", "<article><p>x", "<a href=\"x>y</a>"):
        assert isinstance(html_extract.main_text(broken), str)
    assert html_extract.main_text("<div class='site-header'>x</div><article><div class='post-header'><h1>Title</h1></div><p>Text</p></article>") == "Title\nText"
    assert html_extract.main_text("<div class=ad>x<article><p>Text after an element left open</p></article>") == "Text after an element left open"


PROSE = "It is the way of all of us to be in the house when the sun is up and to go out of it when the sun is not there to be seen by any of us, and so it was with her on that day in the year of which we are to tell you."
ITALIAN = "Il gatto dorme sul tavolo della cucina mentre il sole entra dalla finestra aperta. Nessuno sa perché gli piaccia tanto quel posto, ma ogni mattina si trova lì, con gli occhi chiusi e la coda che pende. " * 2
CHINESE = "猫在厨房的桌子上睡觉，阳光从敞开的窗户照进来。没有人知道它为什么这么喜欢那个地方。" * 8


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div class='overflow-hidden'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='content has-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<article><div class='widget-content'>{PROSE}</div></article>", PROSE),
        (f"<article><h1>Title</h1><div class='widget'>{PROSE}</div></article>", f"Title\n{PROSE}"),
        (f"<form id=page><div><p>{PROSE}</p></div></form>", PROSE),
        (f"<p>{ITALIAN}</p>", ITALIAN.strip()),
        (f"<p>{CHINESE}</p>", CHINESE),
        (f"<article><p>{PROSE}</p><audio src=x>none<p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><svg><g><svg><text>a</text></svg><text>b</text></g></svg><p>c</p></article>", f"{PROSE}\nc"),
        (f"<article><p>{PROSE}</p><p>Acme © 1999</p></article>", f"{PROSE}\nAcme © 1999"),
        (f"<article><p>{PROSE}</p></article><div><p>{PROSE}!</p></div>", f"{PROSE}\n{PROSE}!"),
        (f"<div><p>{PROSE}</p></div><div id=comments><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE),
        (f"<article><p>Short</p><section class=comments><p>{PROSE}</p></section></article>", "Short"),
        (f"<div class=main><h2>Head</h2><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div><div>© x</div>", f"Head\n{PROSE}"),
        (f"<p>{PROSE}</p><div aria-hidden=true><p>{PROSE}</p></div>", PROSE),
    ],
)
def test_html_names_only_lean(page, want):
    assert html_extract.main_text(page) == want


SIDE_CLASSES = "post-comments entry-comments comments-main story-sidebar page-footer article-footer main-nav main-menu post-navigation page-header content-ad entry-related".split()


@pytest.mark.parametrize("name", SIDE_CLASSES + ["-".join(reversed(x.split("-"))) for x in SIDE_CLASSES] + ["postComments", "main_nav"])
def test_html_side_names_beside_main_words(name):
    other = f"{PROSE} And that was the end of it for all of us."
    for page in (f"<div class='{name}'><p>{other}</p></div><div><p>{PROSE}</p></div>", f"<div><p>{PROSE}</p></div><div id='{name}'><p>{other}</p></div>"):
        assert html_extract.main_text(page) == PROSE


@pytest.mark.parametrize("name", ["cookie-notice", "consent", "main-nav", "content-ad"])
def test_html_consent_beside_a_short_text(name):
    own = "It is the way of all of us to be in the house when the sun is up, and so on."
    page = f"<div class='{name}'><p>{PROSE} {PROSE}</p></div><div><p>{own}</p></div>"
    assert html_extract.main_text(page) == own and len(own) < 80
    assert html_extract.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == PROSE  # nothing else is there


def test_html_comments_in_every_container():
    for page in (f"<div class=wrap><article><p>{PROSE}</p><div class='post-comments'><p>{PROSE}!</p></div></article></div>", f"<main><p>{PROSE}</p><section id=article-comments><p>{PROSE}!</p><p>{PROSE}!</p><p>{PROSE}!</p></section></main>", f"<div class=comments-main><div class=content><p>{PROSE}!</p></div></div><p>{PROSE}</p>"):
        assert html_extract.main_text(page) == PROSE


@pytest.mark.parametrize("unit", ["<a '", "<a x='>", "<a x='<>' ", "<div>", "<script>", "<textarea>", "<", "<!--", "&", "<p><b>", "<li>", "<svg>", "<div class=ad>"])
def test_html_of_hostile_pages_is_linear(unit):
    import time

    seconds = []
    for size in (1 << 17, 1 << 20):
        began = time.perf_counter()
        html_extract.main_text(unit * (size // len(unit)))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.02)


def test_html_on_table_by_its_articles(spark):
    """On the driver's pages, whose articles hold no side matter, another way to the same text: the article without its tags."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = {}
    for page_id, _, page in rows:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[page_id] = "\n".join(x for x in parts if x)
    from graphloom.llm.queries import queries

    found = queries()["op6_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in found} == want and len(found) == len(rows)
    twice = html_extract.extract_pages(pages.limit(3).union(pages.limit(3)).withColumn("text", pages["url"]).withColumn("n_chars", pages["page_id"])).collect()
    assert len(twice) == 6 and len({tuple(r) for r in twice}) == 3


def test_html_context():
    long = "It is the way of all of us to be in the house when the sun is up and to go out of it when the sun is not there to be seen by any of us, and so it was with her on that day in the year of which we are to tell you."
    menu = "<div><a href=1>One</a> <a href=2>Two</a></div>"
    page = f"<body>{menu}<p>Menu tail</p>{menu}<p>{long}</p><p>Short one</p><p>{long}</p><p>After</p>{menu}</body>"
    assert html_extract.main_text(page) == f"{long}\nShort one\n{long}"


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("x", "x")
    for r in html_extract.extract_pages(pages).collect():
        assert r.n_chars == len(r.text) > 0 and "<" not in r.text[:1]
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_extract.extract_pages(odd).collect()] == [(None, None, "", 0), (1, "u", "", 0)]


# 7: classifier


def test_grams():
    g = nbsvm.Grams()
    for text in ("", "ab", "abcd", "abcdeabcdeabcdf", "ééé\U0001f642 x" * 50, "no no no"):
        raw = text.encode()
        codes = {int.from_bytes(raw[k : k + nbsvm.GRAM], "little") for k in range(len(raw) - nbsvm.GRAM + 1)}
        want = {int(nbsvm.mixed(np.array([c], dtype=np.uint64))[0]) >> (64 - nbsvm.BUCKETS_LOG2) for c in codes}
        got = g.of(text).tolist()
        assert len(got) == len(set(got)) and set(got) == want


def test_dual_descent_meets_its_conditions():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(200)]
    labels = np.array([int(r.sum() % 7 < 4 or 3 in r) for r in rows])
    ratio = nbsvm.log_count_ratio(rows, labels)
    assert ratio[3] > 0
    weight, bias = nbsvm.dual_descent(rows, labels, ratio, rounds=300, tolerance=1e-4)
    share = np.array([200 / (2 * (labels == k).sum()) for k in (0, 1)])

    def cost(w, b):
        m = nbsvm.margins(rows, ratio, w, b) * (2 * labels - 1)
        return 0.5 * (w @ w + b * b) + (share[labels] * np.maximum(0, 1 - m)).sum()

    best = cost(weight, bias)
    for _ in range(40):
        d = np.zeros_like(weight)
        d[:60] = rng.normal(size=60) * 0.05
        assert cost(weight + d, bias) >= best - 1e-2


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = nbsvm.fit_quality(docs, labels)
    found = {r.doc_id: r for r in nbsvm.score_quality(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for k, r in found.items())
    held = [k for k in truth if found[k].held_out]
    assert sum(found[k].predicted == truth[k] for k in held) >= 0.95 * len(held)
    empty = labels.limit(0)
    assert {round(r.score, 6) for r in nbsvm.score_quality(docs, nbsvm.fit_quality(docs, empty)).collect()} == {0.5}


def dense_model(rows, labels, c=1.0, rounds=4000):
    """The same model from a full matrix: smoothed log ratios of class counts, unit rows, and the dual by its Gram matrix."""
    used = np.unique(np.concatenate(rows))
    full = np.zeros((len(rows), len(used)))
    for k, codes in enumerate(rows):
        full[k, np.searchsorted(used, codes)] = 1
    totals = [(full[labels == k].sum() + (1 << nbsvm.BUCKETS_LOG2)) for k in (0, 1)]
    ratio = np.log((full[labels == 1].sum(0) + 1) / totals[1]) - np.log((full[labels == 0].sum(0) + 1) / totals[0])
    scaled = full * ratio
    norms = np.linalg.norm(scaled, axis=1)
    scaled /= np.where(norms > 0, norms, 1)[:, None]
    y = 2.0 * labels - 1
    gram = (scaled @ scaled.T + 1) * np.outer(y, y)
    most = np.where(labels == 1, len(labels) / (2 * (labels == 1).sum()), len(labels) / (2 * (labels == 0).sum())) * c
    alpha, slope = np.zeros(len(rows)), -np.ones(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(rows)):
            new = min(max(alpha[k] - slope[k] / gram[k, k], 0), most[k])
            if new != alpha[k]:
                slope += gram[:, k] * (new - alpha[k])
                moved, alpha[k] = max(moved, abs(new - alpha[k])), new
        if moved < 1e-10:
            break
    return (scaled @ scaled.T) @ (alpha * y) + (alpha * y).sum()


def test_classifier_equals_a_dense_one(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    taken = docs.join(labels, "doc_id").orderBy("doc_id").limit(300).select("text", "quality").collect()
    grams = nbsvm.Grams()
    rows, y = [grams.of(r.text or "") for r in taken], np.array([r.quality for r in taken])
    ratio = nbsvm.log_count_ratio(rows, y)
    exact = dense_model(rows, y)
    close = nbsvm.margins(rows, ratio, *nbsvm.dual_descent(rows, y, ratio, rounds=5000, tolerance=1e-9))
    assert np.abs(close - exact).max() < 1e-3
    # The tolerance of the query's fit leaves margins near the exact ones, and on the same side where they are clear.
    fitted = nbsvm.margins(rows, ratio, *nbsvm.dual_descent(rows, y, ratio))
    assert np.abs(fitted - exact).max() < 0.1 and (np.sign(fitted) == np.sign(exact))[np.abs(exact) > 0.1].all()


def test_registered_queries_give_every_row(spark):
    """Each query of this part that has no SQL, as it is registered, on the smallest tables."""
    from graphloom.llm.queries import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = {i: library().encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    found = {name: queries()[name](spark, SF).collect() for name in ("op1_token_store", "op2_byte_bpe", "op4_token_counts", "op7_quality_classifier", "op10_substring_dedup")}
    assert all(len(rows) == n and {r.doc_id for r in rows} == set(texts) for rows in found.values())
    start = 0
    for r in sorted(found["op1_token_store"], key=lambda r: r.doc_id):
        ids = [*plain[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in found["op2_byte_bpe"])
    assert all(r.n_tokens == len(plain[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in found["op4_token_counts"])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found["op7_quality_classifier"])
    assert all(r.n_words - r.n_removed_words == len(low_words(r.text)) for r in found["op10_substring_dedup"])


def test_classifier_sample_is_bounded(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(nbsvm.Model, "fit", classmethod(lambda cls, rows, labels: fitted.append((len(rows), sum(4 * len(r) for r in rows)))))
    rows = [(k % 40, f"text {k} of document {k % 40} " * (1 + k % 7), None) for k in range(400)] + [(None, "no id", None), (41, None, None)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(42)] + [(3, 1), (3, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    usable = [k for k in range(42) if zlib.crc32(str(k).encode()) % 5 and k != 40]  # one row each, however often the id occurs; 40 has no text
    nbsvm.fit_quality(docs, labels)
    nbsvm.fit_quality(docs, labels, sample=10)
    nbsvm.fit_quality(docs, labels, sample_bytes=2000)
    assert fitted[0][0] == len(usable) and fitted[1][0] <= 10 and fitted[2][1] <= 2000 and fitted[2][0] > 1


def test_classifier_odd_rows(spark, awkward):
    model = nbsvm.Model.fit([np.array([1, 2]), np.array([3])], np.array([1, 0]))
    found = nbsvm.score_quality(awkward, model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)


# 8: mixing


def test_mixing(spark, real):
    docs = real.selectExpr("doc_id", "source", "text").withColumn("n_tokens", mixing.token_estimate())
    n = {r.doc_id: math.ceil(len((r.text or "").encode()) / 4) for r in real.collect()}
    rows = mixing.plan_mix(docs, block_tokens=2000).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == n
    tokens = collections.Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    weights = {r.source: r for r in mixing.source_weights(docs, Scratch(spark, "t")).collect()}
    share = {s: t / sum(tokens.values()) for s, t in tokens.items()}
    most, least = max(share.values()), min(share.values())
    exponent = max(0.0, 1 - math.log(4) / math.log(most / least))
    raised = {s: p**exponent for s, p in share.items()}
    for s, w in weights.items():
        assert abs(w.weight - raised[s] / sum(raised.values())) < 1e-5
    # Places follow each other without gaps, and copies fill the budget up to one document.
    for s in tokens:
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.place, r.n_tokens))
        at = 0
        for r in own:
            assert r.place == at
            at += r.n_tokens
        dealt = sum(r.copies * r.n_tokens for r in own)
        assert weights[s].target - max(r.n_tokens for r in own) <= dealt <= weights[s].target
        assert min(r.copies for r in own) >= 1
    ratio = [sum(r.copies * r.n_tokens for r in rows if r.source == s) / tokens[s] for s in tokens]
    assert max(ratio) <= 4.01


def test_mixing_entropy_and_odd_rows(spark, awkward):
    docs = awkward.withColumn("n_tokens", mixing.token_estimate())
    w = mixing.source_weights(docs, Scratch(spark, "t"), target_entropy=1.2, max_repeat=None, budget=10_000).collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in w) - 1.2) < 1e-3
    assert sum(r.target for r in w) <= 10_000
    dealt = mixing.deal(awkward)
    assert dealt.columns == awkward.columns
    assert {(r.doc_id, r.text) for r in dealt.collect()} == {(i, t) for i, t, _ in AWKWARD}
    assert mixing.deal(awkward.limit(0)).count() == 0
    plan = mixing.plan_mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixing_of_clashing_columns(spark, awkward):
    from pyspark.sql import functions as F

    names = ("n_tokens", "_n_tokens", "passes", "rest", "block", "place", "copies", "weight", "rows", "tokens", "target")
    docs = awkward.select("doc_id", "text", "source", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    dealt = mixing.deal(docs)
    assert dealt.columns == docs.columns
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in dealt.collect())
    planned = mixing.plan_mix(docs, tokens=mixing.token_estimate())
    assert planned.columns == [c for c in docs.columns if c not in ("block", "place", "copies")] + ["block", "place", "copies"]
    assert planned.count() == len(AWKWARD)


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, f"text number {k} " * 5, "a") for k in range(300)] + [(7, f"other {k} " * 5, "a") for k in range(300)] + [(8, "same", "a")] * 50 + [(9, "x", None)]
    docs = table(spark, rows).withColumn("n_tokens", mixing.token_estimate())
    runs = [mixing.plan_mix(docs.repartition(k), block_tokens=100) for k in (1, 5)]
    a, b = (sorted(str(tuple(r)) for r in x.select("doc_id", "text", "block", "place", "copies").collect()) for x in runs)
    assert a == b and len(a) == len(rows)  # whatever the order in which rows come
    placed = [r for r in runs[0].collect() if r.source == "a" and r.text != "same"]
    sizes = collections.Counter(r.block for r in placed)
    assert len(sizes) > 20 and max(sizes.values()) < 60 and len({r.place for r in placed}) == 600


# 9: near documents


def brute_documents(rows):
    sets = []
    for _, text in rows:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [(i, len(sets[k]), low.get(root(k)), i is None or low[root(k)] == i) for k, (i, _) in enumerate(rows)]


def copies(rng, n):
    """Groups of near copies in chains, so that some members link only through others, and shared passages."""
    rows, word = [], lambda: "w" + str(rng.integers(0, 5000))
    passage = [word() for _ in range(40)]
    for _ in range(n):
        text = [word() for _ in range(int(rng.integers(3, 90)))]
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 40)):
                text[int(rng.integers(0, len(text)))] = word()
        rows.append((len(rows), " ".join(passage + [word() for _ in range(5)])))
    return rows


def test_near_documents(spark, awkward):
    rows = copies(np.random.default_rng(1), 60) + [(1000 + (i or 0) if i is not None else None, t) for i, t, _ in AWKWARD if i != 9]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = minhash.near_documents(docs).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute_documents(rows)))
    assert minhash.near_documents(awkward.limit(0)).count() == 0
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns and minhash.keep_one(awkward.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, None]))


def test_near_documents_on_table(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    assert sorted(tuple(r) for r in minhash.near_documents(real).collect()) == sorted(brute_documents(rows))


def test_one_id_with_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (3, c), (1, a), (None, a), (4, None), (4, ""), (5, c)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, hash int")
    found = minhash.near_documents(docs).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute_documents(rows)))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (3, c), (None, a), (4, None), (4, "")]))


@pytest.mark.parametrize("chunk,most", [(2048, None), (7, None), (7, minhash.BITS)])
def test_documents_that_share_most_of_a_passage(spark, monkeypatch, chunk, most):
    """One bucket of many documents at 60 to 74 percent, and some above the limit among them; with sketches and without."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    if most is not None:
        monkeypatch.setattr(minhash, "MOST", most)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(100)]
    rows = []
    for k in range(150):
        own = [f"o{k}_{j}" for j in range(int(rng.integers(14, 24)))]
        rows.append((2 * k, " ".join(passage + own)))
        if k % 10 == 0:
            rows.append((2 * k + 1, " ".join(passage + own[:-2] + ["x", "y"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = minhash.near_documents(docs).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute_documents(rows)))


def test_units_of_printable_ascii(monkeypatch):
    """They get the library's ids without a call of its whole pipeline for each; those with special strings do call it."""
    encode, lib = encoders.JsonEncoder(encoders.read_vocabulary(P.path("byte_bpe_50k.json"))), library()
    whole, called = encode._whole, []
    monkeypatch.setattr(encode, "_whole", lambda x: called.append(x) or whole(x))
    rng, chars = np.random.default_rng(10), [chr(k) for k in range(33, 127)] + list("abcTHE019'.,-<|>s") * 3
    units = ["".join(rng.choice(chars, int(rng.integers(1, 12)))) for _ in range(3000)] + ["don't", "I'LL", "'s", "(459)", "A.!!", "''ve", "x_1'd"]
    text = " ".join(units[:1500]) + "\n" + "\n".join(units[1500:])
    assert encode(text) == struct.pack(f"<{len(ids := lib.encode(text, add_special_tokens=False).ids)}I", *ids)
    assert not called
    text = "a<|endoftext|>. b"
    assert encode(text) == struct.pack(f"<{len(ids := lib.encode(text, add_special_tokens=False).ids)}I", *ids) and called


def test_near_copies_of_one_text(spark, monkeypatch):
    """The text that all are copies of is a hub of the first round, and the last one makes each pair in one bucket only."""
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(120):
        text = list(base)
        for j in range(int(rng.integers(0, 7))):
            text[int(rng.integers(0, 150))] = f"o{k // 2}_{j}"
        rows.append((k, " ".join(text)))
    for k in range(60):  # two groups at 71 percent, no bound of which excludes its pairs: every shingle is in another text too
        rows.append((200 + k, " ".join([f"p{k % 2}_{j}" for j in range(100)] + [f"q{k // 2}_{j}" for j in range(20)])))
    made, confirmed, save, confirm = [], {}, Scratch.save, minhash._confirmed

    def spy(self, df, name, codec="zstd"):
        out = save(self, df, name, codec)
        if name == "pairs-True":
            made.append((df._jdf.queryExecution().optimizedPlan().nodeName(), out.count(), out.distinct().count()))
        return out

    def links(docs, classes, pairs, repeated, scratch, name):
        confirmed[name] = out = confirm(docs, classes, pairs, repeated, scratch, name)
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    monkeypatch.setattr(minhash, "_confirmed", links)
    found = minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute_documents(rows)))
    ((root, n, distinct),) = made
    assert root != "Aggregate" and n == distinct > 0  # no pair is made twice, without taking repeated ones away
    assert not confirmed["round-False"].isEmpty() and confirmed["round-True"].isEmpty()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(50)] + [(5, None), (7, 7)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "t")).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((k, root(k)) for k in parent)


# 10: repeated passages


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low_words(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def flagged(text, spans):
    """For each word of the text whether a span covers it; spans begin and end between words."""
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        inside = [a <= m.start() and m.end() <= b for a, b in spans]
        assert all(i or b <= m.start() or m.end() <= a for i, (a, b) in zip(inside, spans))
        out.append(any(inside))
    return out


def line_ranges(text, floor=None):
    at = 0
    for line in (text or "").split("\n"):
        words = low_words(line)
        if len(words) >= (floor or line_dedup.LINE_WORDS):
            yield at, at + len(words), tuple(words)
        at += len(words)


def check_repeats(docs):
    """What the operator promises, by dicts of lines and of all runs of 25 and 60 words, without its cuts."""
    source = docs.collect()
    found = line_dedup.remove_repeats(docs).collect()
    assert len(found) == len(source)
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    text_of = collections.defaultdict(list)
    for r in source:
        text_of[rank(r), r.n_chars].append(r.text)
    first, grams, n = {}, {25: {}, 60: {}}, line_dedup.PASSAGE_WORDS
    for r in sorted(source, key=rank):
        words = low_words(r.text)
        for *_, line in line_ranges(r.text):
            first.setdefault(line, rank(r))
        for size in grams:
            for k in range(len(words) - size + 1):
                grams[size].setdefault(tuple(words[k : k + size]), rank(r))
    repeated = caught = 0
    for r in found:
        (text, *others), spans = text_of[rank(r), r.n_chars], [tuple(s) for s in r._dedup_spans]
        assert not others or set(others) == {text}
        gone, words = flagged(text, spans), low_words(text)
        assert (r._dedup_words, r._dedup_removed_words) == (len(words), sum(gone))
        pieces, at = [], 0
        for a, b in spans:
            pieces.append(text[at:a])
            at = b
        assert r.text == (None if text is None else "".join([*pieces, text[at:]]))
        allowed, seen, own = [False] * len(words), {}, {}
        for a, b, line in line_ranges(text):
            if first[line] < rank(r) or line in seen:
                assert all(gone[a:b])  # no repeated line is left
                allowed[a:b] = [True] * (b - a)
            seen[line] = True
        for k in range(len(words) - n + 1):
            gram = tuple(words[k : k + n])
            if grams[25][gram] < rank(r) or own.setdefault(gram, k) <= k - n:
                allowed[k : k + n] = [True] * n
        assert all(a or not g for a, g in zip(allowed, gone))  # nothing goes that doesn't stand earlier
        again = [False] * len(words)
        for k in range(len(words) - 59):
            if grams[60][tuple(words[k : k + 60])] < rank(r):
                again[k : k + 60] = [True] * 60
        repeated += sum(again)
        caught += sum(g for a, g in zip(again, gone) if a)
    return repeated, caught


@pytest.mark.parametrize("which,hot", [("awkward", 20_000), ("real", 20_000), ("real", 50)])
def test_repeats(request, which, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 1000 if hot > 50 else 2)
    docs = request.getfixturevalue(which)
    # Null ids rank by a hash of their text, which the check doesn't know; there is one in the table at most.
    repeated, caught = check_repeats(docs)
    assert caught >= 0.9 * repeated
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_lines_exactly(spark):
    """Without repeated runs of 25 words the result is what a dict of lines gives."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    pool = [" ".join(word() for _ in range(int(rng.integers(4, 18)))) for _ in range(30)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 9))):
            line = pool[int(rng.integers(0, 30))]
            lines += [line.upper() if k % 7 == 0 else line.replace(" ", "  ") if k % 5 == 0 else line, f"{word()} {word()} {word()}"]
        rows.append((k, "\n".join(lines), "s"))
    seen, want = set(), {}
    for k, text, _ in rows:
        kept = []
        for line in text.split("\n"):
            key = tuple(low_words(line))
            if len(key) < line_dedup.LINE_WORDS or key not in seen:
                kept.append(line)
            if len(key) >= line_dedup.LINE_WORDS:
                seen.add(key)
        want[k] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(table(spark, rows).repartition(7)).collect()}
    assert got == want


@pytest.mark.parametrize("floor", [1, 10])
def test_line_floor(spark, floor):
    """With a floor of 1 every repeated line goes, by a dict of all lines; with 10 the short ones stay."""
    rng = np.random.default_rng(3)
    pool = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n)) for n in (1, 2, 3, 5, 9, 10, 14) for _ in range(4)]
    rows = [(k, "\n".join([pool[int(rng.integers(0, len(pool)))] for _ in range(6)] + ["", "  "]), "s") for k in range(50)]
    seen, want = set(), {}
    for k, text, _ in rows:
        kept = []
        for line in text.split("\n"):
            key = tuple(low_words(line))
            if len(key) < floor or key not in seen:
                kept.append(line)
            if len(key) >= floor:
                seen.add(key)
        want[k] = low_words(" ".join(kept))
    got = {r.doc_id: low_words(r.text) for r in line_dedup.remove_repeats(table(spark, rows).repartition(5), line_words=floor).collect()}
    # Runs of 25 words that recur across lines go as passages; here no two texts share one beyond their lines.
    assert got == want if floor == 1 else all(len(got[k]) <= len(want[k]) for k in want)


def test_repeats_with_odd_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, f"x {b} y", "s"), (None, a, "s"), (None, a, "s"), (None, f"{a}\nown", "s"), (None, None, "s"), (3, None, "s")]
    got = sorted(map(str, ((r.doc_id, r.text) for r in line_dedup.remove_repeats(table(spark, rows)).collect())))
    # Rows of one id keep what they have; null ids come last and lose what stands before.
    kept = [r for r in got if r.startswith("(1,")]
    assert kept == sorted(map(str, [(1, a), (1, b), (1, b)]))
    assert str((3, None)) in got and str((None, None)) in got and str((None, "")) in got and str((None, "own")) in got
    assert len(next(r for r in got if r.startswith("(2,")).split()) < 30


def test_passage_in_lines(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = words(90)
    rows = [(k, f"{words(40)} {passage if k % 3 == 0 else ''} {words(30)}\n{words(20)}", "s") for k in range(30)]
    for r in line_dedup.remove_repeats(table(spark, rows)).collect():
        gone = r._dedup_removed_words
        assert 60 <= gone <= 90 if r.doc_id % 3 == 0 and r.doc_id > 0 else gone == 0


def test_common_pieces_stay(spark):
    """Every 20 words of the last text stand in some earlier one, but no 25 words of it stand together in any."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows = [(k, f"start {k} {' '.join(words[k : k + 20])} end {k}", "s") for k in range(0, 380, 5)]
    rows.append((1000, " ".join(words), "s"))
    found = {r.doc_id: r for r in line_dedup.remove_repeats(table(spark, rows)).collect()}
    assert found[1000].text == rows[-1][1] and found[1000]._dedup_removed_words == 0

"""Operators that work in Arrow batches: brute force, round trips, odd input."""

import html
import random
import re
import zlib

import numpy as np
import pytest
from llm.helpers import ODD_TEXTS, classes, corpus, low_words, ppm_model, ppm_score, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm import ngram_join as NJ
from corvid.llm import ppm
from corvid.llm import token_files as TF
from corvid.llm import warc as W
from corvid.llm.common import shared_path
from corvid.llm.query_token_files import tokenizer_path

LONG = prose(2, 30_000)


# -- token files --------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbB zZ09.,!'<|>\n\tÀßÿé×÷\x1c\x7fŒΣσ́İ ªº²")), st.characters()), max_size=30), max_size=4))
def test_encoder_is_the_library(texts):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["it's <|endoftext|>", "Don't", "ab <|x"]
    got = TF.encoder(tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbB zZ09.,!'<|>\n\tÀßÿé")), st.characters()), max_size=30), max_size=4))
def test_encoder_is_the_library_with_another_file(texts):
    """Rules that the encoder doesn't know are left to the library."""
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["Hello World 12", "", " Ab"]
    assert TF.cuts_plain_texts(tokenizer_path()) and not TF.cuts_plain_texts(path)
    got = TF.encoder(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_pieces_are_learned_again(monkeypatch, library):
    monkeypatch.setattr(TF, "MEMO_PIECES", 20)
    e = TF.Encoder(tokenizer_path())
    texts = [prose(i, 30).encode("latin-1", "ignore").decode("latin-1") + " 2024!? x" for i in range(20)] + ["", " \n", "7"]
    for part in (texts[:9], texts[5:], texts):
        assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_token_files_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(TF, "FRAME_BYTES", 1 << 12)
    monkeypatch.setattr(TF, "FILE_BYTES", 1 << 16)
    rows = [(i, prose(i, 200)) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000, LONG), (5, "again"), (None, "no id")]
    random.Random(3).shuffle(rows)
    out = shared_path(spark, "test-tokens")
    got = TF.tokenize_corpus(corpus(spark, rows), out, tokenizer_path()).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    some = TF.read_tokens(spark, out, [7, 2000, 99999]).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 2000]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in some)


def test_token_files_empty_table(spark):
    assert TF.tokenize_corpus(corpus(spark, []), shared_path(spark, "none"), tokenizer_path()).collect() == []


def test_reader_decompresses_only_what_it_needs_and_checks_it(monkeypatch):
    monkeypatch.setattr(TF, "FRAME_BYTES", 64)
    b = TF.FileBuilder()
    for i in range(50):
        b.add(i, np.full(10, i, "<u4").tobytes())
    data = b.finish() + b"\x8f"
    reader = TF.FileReader(data)
    calls = []
    real = reader.unpack
    reader.unpack = lambda *a, **k: calls.append(1) or real(*a, **k)
    assert [x[0] for x in reader.read({3})] == [3] and len(calls) == 1
    assert [x[0] for x in reader.read()] == list(range(50))
    bad = bytearray(data)
    bad[int(reader.at[1]) - 1] ^= 1
    with pytest.raises(Exception):
        list(TF.FileReader(bytes(bad)).read())
    import zstandard
    frames = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(frames) == 50 * 40  # any zstandard reader skips the index and the table


# -- n-gram join --------------------------------------------------------------

def near(text, seed, edits):
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def join_rows():
    passage = prose(77, 55)
    base = prose(78, 150)
    rows = [(i, near(base, i, i % 9)) for i in range(60)]  # a group in which many pairs do not link
    rows += [(100 + i, prose(200 + i // 2, 80) + (" extra words" if i % 2 else "")) for i in range(40)]
    rows += [(200 + i, prose(400 + i, 12) + " " + passage) for i in range(40)]  # short texts, one passage
    rows += [(300 + i, base.upper() if base.isascii() else base) for i in range(30)]
    rows += [(400, "a b c"), (401, "A  B\tc"), (402, "a b"), (403, "a b c d e"), (404, "a b c d e f"), (405, LONG), (406, near(LONG, 1, 20))]
    chain = prose(500, 100).split()
    rows += [(500 + i, " ".join(chain[6 * i:] + prose(600 + i, 6 * i).split()[:6 * i])) for i in range(10)]
    return rows + [(900 + i, t) for i, t in enumerate(ODD_TEXTS)]


def test_classes_match_brute_force(spark):
    rows = join_rows()
    got = {r["doc"]: (r["n"], r["component"]) for r in NJ.similarity_classes(corpus(spark, rows)).collect()}
    assert got == classes(rows)


def test_enumeration_alone_finds_all(spark, monkeypatch):
    monkeypatch.setattr(NJ, "PIVOT_ROUNDS", 1)
    rows = join_rows()[:110]
    got = {r["doc"]: (r["n"], r["component"]) for r in NJ.similarity_classes(corpus(spark, rows)).collect()}
    assert got == classes(rows)


def test_rounds_end_when_nothing_is_left_to_link(spark, monkeypatch):
    tested, real = [], NJ.linked
    monkeypatch.setattr(NJ, "linked", lambda pairs, count, sets, percent: tested.append(count) or real(pairs, count, sets, percent))
    copies = [(100 + i, prose(200 + i // 2, 80) + (" extra words" if i % 2 else "")) for i in range(20)]
    halves = [(i, prose(300 + i // 2, 60) + " " + prose(400 + i, 25)) for i in range(20)]  # candidates without links
    for given, most in ((copies + halves, 4), ([(i, prose(7000 + i, 60)) for i in range(8)], 0)):
        tested.clear()
        got = {r["doc"]: (r["n"], r["component"]) for r in NJ.similarity_classes(corpus(spark, given)).collect()}
        assert got == classes(given)
        assert len(tested) <= most, tested


def test_edges_to_least_labels(spark):
    edges = [(9, 7), (7, 4), (4, 9), (3, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (5, 5)]
    got = {r["sid"]: r["label"] for r in NJ.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 4, 7: 4, 3: 2} | {i: 20 for i in range(21, 26)}
    stars = spark.createDataFrame([(9, 4), (7, 4), (3, 2)], "a long, b long")
    assert sorted(map(tuple, NJ.classes(stars).collect())) == [(3, 2), (7, 4), (9, 4)]


def test_one_per_class_and_odd_rows(spark):
    docs = corpus(spark, [(1, "a b c d e f"), (2, "A b c d e F"), (2, "A b c d e F"), (3, "else"), (4, None), (5, ""), (None, "else")])
    kept = NJ.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5] and ids.count(None) == 1
    assert NJ.similarity_classes(corpus(spark, [])).collect() == []


def test_one_row_of_a_class_by_id_and_set(spark):
    a, b, c, d = prose(9500, 40), prose(9501, 40), prose(9502, 40), prose(9503, 40)
    rows = [(1, a), (1, a), (1, a), (2, a), (2, b), (3, c), (3, c + " more"), (3, d), (4, d), (5, d), (5, ""), (5, None), (6, a), (None, a)]
    kept = NJ.one_per_class(corpus(spark, rows))
    assert kept.columns == corpus(spark, []).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    extended = (3, c + " more") in got  # one of the two with id 3, by set id
    want = [(1, a), (2, b), (3, c + " more" if extended else c), (3, d), (5, ""), (5, None), (None, a)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_prefix_sizes():
    for n in range(1, 400):
        assert NJ.prefix_size(n) == n - -(-75 * n // 100) + 1
        assert NJ.prefix_size(n) <= NJ.wide_prefix(n, 75) <= n


@pytest.mark.parametrize("n, more", [(7, 1), (10, 2), (19, 5)])
def test_pairs_at_the_threshold_are_linked(spark, n, more):
    rows = []
    for seed in range(300):
        text, extra = prose(9000 + seed, n), prose(70_000 + seed, more)
        rows += [(2 * seed, text), (2 * seed + 1, f"{text} {extra}" if seed % 2 else f"{extra} {text}")]
    got = {r["doc"]: (r["n"], r["component"]) for r in NJ.similarity_classes(corpus(spark, rows)).collect()}
    assert got == classes(rows)


def test_least_shared_tokens_are_guaranteed():
    rng = np.random.default_rng(5)
    for n in range(1, 45):
        assert 1 <= NJ.least_shared(n, 75) <= NJ.wide_prefix(n, 75) - NJ.prefix_size(n) + 1
        for m in range(n, 4 * n // 3 + 1):
            both = -(-75 * (n + m) // 175)
            if both > n:
                continue
            for _ in range(40):
                x = rng.permutation(n + m - both)
                a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
                shared = np.intersect1d(a[:NJ.wide_prefix(n, 75)], b[:NJ.wide_prefix(m, 75)]).size
                assert shared >= max(NJ.least_shared(n, 75), NJ.least_shared(m, 75))


# -- language model -----------------------------------------------------------

@pytest.mark.parametrize("max_words", [ppm.MAX_WORDS, 10])
def test_scores_match_brute_force(spark, max_words):
    import math
    from collections import Counter
    texts = [prose(i, 30) for i in range(40)] + [t for t in ODD_TEXTS if t is None or len(t) < 1000] + ["the cat sat on the mat " * 20] * 4
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    model, order = ppm_model(train, 3), 3
    c = Counter(w for t in train for w in low_words(t) + ["\0end"])
    n, v = sum(c.values()), len(c)
    got = ppm.score_texts(corpus(spark, rows), order=order, max_words=max_words).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, t in rows:
        r, w = by[i], low_words(t) + ["\0end"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(ppm_score(t, model, order), rel=1e-9)


@pytest.mark.parametrize("max_grams", [50, 0])
def test_scores_need_no_bound_of_the_model(spark, max_grams):
    texts = [prose(i, 30) for i in range(30)] + [t for t in ODD_TEXTS if t is None or len(t) < 1000] + ["the cat sat on the mat " * 20] * 4
    rows = list(enumerate(texts)) + [(None, "no id"), (0, "\x01\x02 unseen \x01\x02")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    model, order = ppm_model([t for i, t in rows if not held(i)], 3), 3
    want = sorted((i if i is not None else -1, ppm_score(t, model, order)) for i, t in rows)
    for bound in (max_grams, ppm.MAX_GRAMS):
        got = ppm.score_texts(corpus(spark, rows), order=order, max_grams=bound).collect()
        got = sorted((r["id"] if r["id"] is not None else -1, r["score"]) for r in got)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_probabilities_sum_to_one():
    codes = np.concatenate([ppm.gram_codes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 3)[0] for t in (prose(1, 50), "aaaa", "")])
    tables = [np.unique(codes & ((1 << (9 * (k + 1))) - 1), return_counts=True) for k in range(4)]
    trie = ppm.Trie([t[0] for t in tables], [t[1] for t in tables])
    for context in [codes[5] >> 9, codes[-1] >> 9, 0, (97 << 18) | (97 << 9) | 97, 1 << 20]:
        p = 10 ** trie.log10((int(context) << 9) | np.arange(257))
        assert p.sum() == pytest.approx(1.0)


def test_model_bound_and_empty(spark):
    docs = corpus(spark, [(i, prose(i, 40)) for i in range(30)])
    counts = ppm.corpus_counts(docs, "text", 2)
    trie = ppm.fit_trie(counts.filter("kind = 0").select("key", "n"), 2, max_grams=50)
    assert all(len(g) <= 50 for g in trie.grams)
    assert ppm.score_texts(corpus(spark, [])).collect() == []
    alone = ppm.score_texts(corpus(spark, [(None, "ab")])).collect()[0]  # held out: nothing to learn from
    assert alone["score"] == pytest.approx(-3 * np.log10(257)) and alone["base_score"] == pytest.approx(0.0)


# -- WARC ---------------------------------------------------------------------

PAGES = [(1, "http://a.example/x?y=1", '<html lang="en"><head><title> A &amp; B </title><script>var t="</p>";</script><style>p{}</style></head><body><!-- no --><p>One&nbsp;two<br>three <b>fo</b>ur</p><a href="/u?a=1&amp;b=2">L</a><a class=k href=\'z\'>Z</a></body></html>'),
         (2, None, None), (3, "http://b.example/\r\nX: y", ""), (None, "http://c.example/", "plain é < text"), (4, "http://d.example/", "<p>" + LONG + "</p>"),
         (1, "http://a.example/x?y=1", "<p>other"), (5, "http://e.example", "<div>\r\n\r\nWARC/1.1\r\n</div>")]


def test_derivatives_link_and_keep(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, content string")
    source, out = shared_path(spark, "test-warc"), shared_path(spark, "test-derived")
    W.write_responses(pages, source)
    W.build_derivatives(spark, source, out)
    responses = {r["record_id"]: r for r in W.read_records(spark, source).collect()}
    rows = W.read_records(spark, out).collect()
    assert len(responses) == len(PAGES) and len(rows) == 2 * len(PAGES)
    assert all(r["digest_ok"] for r in [*responses.values(), *rows])
    text = {r["record_id"]: r for r in rows if r["type"] == "conversion"}
    for m in (r for r in rows if r["type"] == "metadata"):
        c, r = text[m["concurrent_to"]], responses[m["refers_to"]]
        assert c["refers_to"] == m["refers_to"] and c["target_uri"] == m["target_uri"] == r["target_uri"]
        assert m["row_id"] == c["row_id"] == r["row_id"]
        assert f"sourcePayloadDigest: {r['payload_digest']}" in bytes(m["block"]).decode()
        assert "http-content-type: text/html; charset=utf-8" in bytes(m["block"]).decode()
    first = next(c for c in text.values() if c["row_id"] == "1" and b"One" in bytes(c["block"]))
    assert bytes(first["block"]).decode() == "A & B\nOne two\nthree four\nLZ"
    links = next(bytes(m["block"]).decode() for m in rows if m["concurrent_to"] == first["record_id"])
    assert re.findall(r"outlink: (.*)\r", links) == ["/u?a=1&b=2", "z"] and "title: A & B\r" in links
    assert any(r["target_uri"] == "http://b.example/%0D%0AX:%20y" for r in responses.values())


def test_big_records_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 1 << 10)
    rows = spark.createDataFrame([(1, "http://x.example/", "ab" * (9 << 20)), (2, "http://y.example/", "c")], "page_id long, url string, html string")
    out = shared_path(spark, "test-big")
    W.write_responses(rows.coalesce(1), out)
    assert sorted(len(r["block"]) > 1 << 24 for r in W.read_records(spark, out).collect()) == [False, True]
    none, derived = shared_path(spark, "test-none"), shared_path(spark, "test-none")
    W.write_responses(rows.limit(0), none)
    W.build_derivatives(spark, none, derived)
    assert W.read_records(spark, derived).collect() == []


def test_plain_text_of_entities():
    assert W.plain_text("<p>a &lt;b&gt; c</p>") == "a <b> c" == html.unescape("a &lt;b&gt; c")


def test_what_is_left_open_is_no_text_and_takes_no_time():
    import time
    for page, text in [("a<script>x", "a"), ("a<!-- b", "a"), ("a<style>b</style >c", "ac"), ("a<title>b", "a\nb"), ("a <b", "a"), ("1 < 2 <3", "1 < 2 <3"),
                       ("<p>a</p>b<br/>c", "a\nb\nc"), ("a<SCRIPT >x</script\n>b", "ab"), ("a<!-->b-->c", "ac"), ("</script>a", "a")]:
        assert W.plain_text(page) == text, page
    for opening in ("<script ", "<title>", "<!-- ", '<a href="', "<a href=' <a ", "<style>", "<", "</", "<title>x</titl "):
        begun = time.perf_counter()
        W.Page(opening * (1_000_000 // len(opening))).text()
        assert time.perf_counter() - begun < 2, opening


def test_page_metadata_outside_what_is_hidden():
    p = W.Page("<HTML data-lang=x lang='de-AT'><meta charset=\"latin-1\"><!-- <title>no</title> <a href=no> --><title> A\n &amp; <b>B </title>"
               "<a class=x data-href=no href = \"q>1\">t</a><a href=z>t</a><a href='open>t</a><script><a href=no></a></script><title>2</title>")
    assert (p.title, p.language, p.charset, p.links) == ("A & <b>B", "de-AT", "latin-1", ["q>1", "z", "'open"])


def test_query_links_every_page_once(spark, tmp_path):
    """Titles, links and texts against a parser of the standard library; equal pages stay rows of their own."""
    from html.parser import HTMLParser
    from corvid.llm.queries import QUERIES

    class Plain(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.links, self.names, self.heading, self.inside = [], [], None, []
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            self.inside.append(tag)
            self.links += [v for k, v in attrs if tag == "a" and k == "href" and v is not None]

        def handle_endtag(self, tag):
            self.inside = self.inside[:-1]

        def handle_data(self, data):
            if self.inside[-1:] == ["title"] and self.heading is None:
                self.heading = " ".join(data.split())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.union(pages.limit(5)).write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["op10_warc_derivatives"](spark, str(tmp_path)).collect()
    assert len(rows) == pages.count() + 5
    of = {r.page_id: r.html or "" for r in pages.collect()}
    for r in rows:
        plain = Plain(of[r.page_id])
        assert (r.n_links, r.title) == (len(plain.links), plain.heading or ""), r.page_id
        assert r.text_chars == len(W.plain_text(of[r.page_id])) and r.same_source and r.digests_ok
        assert r.payload_digest == W.digest(of[r.page_id].encode())

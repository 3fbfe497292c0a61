import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import words as W
from tessel.llm.benchmark_overlap import ItemIndex, benchmark_overlap, united
from tessel.llm.common import runs, utf8
from tessel.llm.html_text import html_text, main_text
from tessel.llm.token_counts import quantile, suffix_sums, token_counts, truncated_total
from tessel.llm.token_file import EliasFano, Encoder, token_files
from tessel.llm.trie_pieces import Pieces, decode_pieces, encode_pieces, piece_ids

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \t\n\x0b.,é漢\x00-_", max_size=30)))
def test_words_match_the_patterns(texts):
    for letters, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, begin = W.words(*utf8(pa.array(texts, pa.string())), letters)
        want = [re.findall(pattern, t.replace("B", "b")) for t in texts]
        assert np.diff(begin).tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        same = {}
        for h, w in zip(hashes.tolist(), flat, strict=True):
            assert same.setdefault(w, h) == h
        assert len(set(same.values())) == len(same)


def test_runs_cover_all_rows():
    offs = np.array([0, 5, 5, 100, 101, 101])
    assert [r for a, b in runs(offs, 10) for r in range(a, b)] == [0, 1, 2, 3, 4]


def _overlap_brute(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for item, other in items:
            w = words(other)
            n = min(10, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for p in range(len(own) - n + 1) if n else ():
                if tuple(own[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(item)
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_overlap_against_brute_force(spark, documents, block_words):
    rng = random.Random(5)
    vocabulary = ["a", "b", "ab", "é", "7"]  # few words, so that windows repeat and overlap
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([1, 4, 9, 10, 11, 25])) if i % 3 else [f"u{i}"] * 12)) for i in range(14)] + [(98, None), (99, " .. ")]
    rows = []
    for i in range(60):
        w = make(rng.randrange(0, 60))
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = items[rng.randrange(14)][1].upper().split()
        rows.append((i, "--".join(w)))
    rows += [(100, None), (101, ""), (102, "b " * 3000), (102, "b " * 3000)]
    found = benchmark_overlap(spark, documents(rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = [tuple(r)[:6] for r in found.collect()]
    assert sorted(got, key=str) == _overlap_brute(rows, items)


def test_overlap_without_items_or_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in benchmark_overlap(spark, documents([(1, "a b")]), none).collect()] == [False]
    assert benchmark_overlap(spark, documents([]), none).collect() == []
    assert united([(0, 3), (2, 5), (7, 9)]) == [(0, 5), (7, 9)]
    assert ItemIndex([], []).hits(np.zeros(0, np.uint64), list)[1] == []


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_overlap_of_repeated_and_null_ids(spark, documents, block_words):
    """Different texts under one id or none, and items that share an id or have none."""
    a, b, c, d = ("{0}1 {0}2 {0}3 {0}4 {0}5 {0}6 {0}7 {0}8 {0}9 {0}10 {0}11 {0}12".format(x) for x in "abcd")
    items = [(5, a), (5, b), (None, c), (None, "d1 d2 d3"), (7, "d12")]
    rows = [(1, a), (1, b), (1, "no words of any item at all here now or ever x"), (None, a), (None, d), (None, c + " " + b), (2, None), (2, a + " " + b), (2, c + " " + d), (1, a)]
    found = benchmark_overlap(spark, documents(rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in found.collect()), key=str)
    want = [(1, 12, 12, 1, [5]), (1, 12, 12, 1, [5]), (1, 12, 0, 0, []), (None, 12, 12, 1, [5]), (None, 12, 4, 2, [7, None]), (None, 24, 24, 2, [5, None]), (2, 0, 0, 0, []), (2, 24, 24, 1, [5]), (2, 24, 16, 2, [7, None]), (1, 12, 12, 1, [5])]
    assert got == sorted(want, key=str)
    digest = {r["items_sha256"] for r in found.collect() if r["items"] == [7, None]}
    assert digest == {hashlib.sha256(b"7").hexdigest()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    own, at = EliasFano.load(memoryview(raw := EliasFano.of(np.array(values, np.uint64)).dump()), 0)
    assert own.all().tolist() == values and at == len(raw)
    assert [own.select(i) for i in range(0, len(values), 7)] == values[::7]
    assert all(own.between(a, b).tolist() == values[a:b] for a in range(0, len(values), 90) for b in (a + 1, a + 77, len(values)) if b <= len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 20_000))
    assert len(EliasFano.of(values).dump()) * 8 < 12.5 * len(values)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = Encoder(path), Tokenizer.from_file(path)
    texts = ["", None, " a¤b <|endoftext|> x", "J̌ İx ΑΣ. it's we'll 12,5.. a.b, é.́, \x1cx\x85y​z q", "汉字,。,. ...,., a,,", "x" * 20_000, "Élan ÉLAN éLAN. (Straße) étude"]
    rng = random.Random(6)
    texts += ["<|ENDOFTEXT|> <|EndOfText|> <|STARTOFTEXT|> <|startoftext|> x<|endoftext|>y. <|ENDOFTEXT|>.", "क़. क़क़,, ﬁ. Ǆ! ŉ a.' b.'s can't. DON'T, x\u200by. \u0301a. é. ª² 五5五", "a. b. c.'re d!? e," * 50]
    texts += ["".join(rng.choice("abE .,'é漢1¤<|>\x1f") for _ in range(40)) for _ in range(500)]
    texts += ["".join(rng.choice("ab'stre!?. क़é१") for _ in range(40)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file_ids", [1 << 22, 40])
def test_token_files_against_the_library(spark, documents, file_ids):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i * 3 - 20, "word " * (i % 9) + str(i)) for i in range(60)] + [(7000, None), (7001, ""), (7002, "long text " * 5000), (None, "null id")]
    got = token_files(spark, documents(rows), "word_bpe_49k.json", end_id=2, file_ids=file_ids).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc, text) in zip(got, rows, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_repeated_and_null_ids(spark, documents):
    rows = [(None, f"null {i}") for i in range(40)] + [(5, f"five {i}") for i in range(40)] + [(6, None)]
    got = token_files(spark, documents(rows).repartition(7), "word_bpe_49k.json", file_ids=30).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]


def test_token_files_of_an_empty_table(spark, documents):
    assert token_files(spark, documents([]), "word_bpe_49k.json").collect() == []


def test_pieces_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, whole = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = ["", None, "  a  b\n c\t▁d \x00 é漢😀", " ", "   ", "a ", "<s> </s> <0x0A> <unk>", "x" * 3000]
    texts += ["".join(rng.choice("abcdeinrst  é漢\n.") for _ in range(60)) for _ in range(800)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(ids, np.int32)
        assert ids.tolist() == whole.encode(text or "")
        assert own.decode(ids) == (text or "").replace("▁", " ")


def test_unigram_paths_have_the_best_score():
    own = Pieces(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    best = lambda w: max((sum(own.score[p] for p in parts) for parts in _splits(w) if all(p in own.score for p in parts)))
    for word, pieces in zip(ws := sorted(["▁then", "▁there", "▁these", "▁others"]), own.segment(ws), strict=True):
        assert "".join(pieces) == word and abs(sum(own.score[p] for p in pieces) - best(word)) < 1e-6


def _plain_viterbi(own, word):
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        found = [(best[a][0] + own.score[word[a:end]], [*best[a][1], word[a:end]]) for a in range(end) if word[a:end] in own.score]
        best.append(max(found, key=lambda x: x[0]) if found else (best[end - 1][0] + own.least - 10.0, [*best[end - 1][1], word[end - 1]]))
    return best[-1]


def test_unigram_paths_of_real_texts(spark):
    """Whole words of a table, prefixes shared, against a plain pass for each word."""
    own = Pieces(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:60]
    words = sorted({"▁" + w for t in texts for w in t.split()})
    assert len(words) > 500
    value = lambda parts: sum(own.score.get(p, own.least - 10.0) for p in parts)
    for word, pieces in zip(words, own.segment(words), strict=True):
        assert "".join(pieces) == word and abs(value(pieces) - _plain_viterbi(own, word)[0]) < 1e-6, word


def test_pieces_of_whole_texts_without_spaces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, whole = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(17)
    texts = ["".join(rng.choice("aeinrst.\n") for _ in range(4000)), "ab" * 3000, "漢字" * 2000, "a" * 1_000_000, " " * 3000, "▁" * 50 + " x"]
    ids, count, exact = own.flat(pa.array([*texts, None, ""]))
    assert count[-2:].tolist() == [0, 0] and exact.tolist() == [True] * 5 + [False] + [True] * 2
    at = 0
    for text, n in zip(texts[:3] + texts[4:], np.delete(count, 3), strict=False):
        at = int(count[: (texts.index(text))].sum())
        assert ids[at : at + n].tolist() == whole.encode(text)


def _splits(word):
    yield [word]
    for i in range(1, len(word)):
        for rest in _splits(word[i:]):
            yield [word[:i], *rest]


def test_piece_ids_round_trip(spark, documents):
    rows = [(1, "Some  text\nhere."), (2, None), (3, ""), (4, "a▁b"), (1, "Some  text\nhere."), (None, "é" * 50_000)]
    df = documents(rows, "piece_ids int, exact int")
    out = encode_pieces(df)
    assert out.columns == [*df.columns, "piece_ids_", "n_pieces", "exact_"]
    back = decode_pieces(out.select("doc_id", "piece_ids_"), ids_col="piece_ids_").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(d), (t or "").replace("▁", " ")) for d, t in rows)
    assert [r["exact"] for r in piece_ids(spark, df.where("doc_id = 4")).collect()] == [False]
    assert piece_ids(spark, documents([])).collect() == []


def test_counts_and_suffix_sums(spark, documents):
    lengths = [0, 0, 3, 5, 5, 9, 2000, 5000]
    hist = suffix_sums(spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "n_tokens long, n_docs long")).cache()
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["docs_at_most"] == sum(x <= n for x in lengths)
        assert r["tokens_at_most"] == sum(x for x in lengths if x <= n) and r["truncated_tokens"] == sum(min(x, n) for x in lengths)
    assert hist.agg(truncated_total(hist, 7).alias("t")).first()["t"] == sum(min(x, 7) for x in lengths)
    assert quantile(hist, 0.5).first()["n_tokens"] == 5
    found = token_counts(spark, documents([(1, None), (2, ""), (3, "one two"), (3, "one two")])).collect()
    assert sorted((r["n_tokens"], r["n_docs"]) for r in found) == [(0, 2), (2, 2)]
    assert token_counts(spark, documents([])).collect() == []


PAGE = '<body><header>Site</header><ul class="menu"><li><a href=x>A</a><li>B</ul>%s<div id="comments"><p>A long comment, very very very long comment text.</p></div><footer>c</footer>'


def test_main_text_of_an_article():
    page = PAGE % '<article><h1>T &amp; u</h1><p>a</p><aside>z</aside><p><a href="q">only link</a></p><script>var x="</article>"</script><!-- <p>no --><p title="a>b">e<br>f<form><p>g</form></article>'
    assert main_text(page) == "T & u\n\na\n\nonly link\n\ne f"


def test_main_text_drops_runs_of_links_in_an_article():
    links = "".join(f"<li><a href={i}>Another page {i}</a>" for i in range(6))
    page = PAGE % f"<article><h1>Title</h1><p>First paragraph.</p><ul>{links}</ul><h2><a href=t>Part two</a></h2><section><p>Second paragraph.</p></section></article>"
    assert main_text(page) == "Title\n\nFirst paragraph.\n\nAnother page 0\n\nPart two\n\nSecond paragraph."


def test_main_text_of_parts():
    page = PAGE % "<main><h1>Headline</h1><article><p>The first part.</p></article><article><p>The second, longer part.</p></article></main>"
    assert main_text(page) == "Headline\n\nThe first part.\n\nThe second, longer part."
    page = PAGE % "<div><article><p>The first part.</p></article><article><p>The second, longer part.<article><p>A reply.</p></article></article></div><section><article><p>Else</p></article></section>"
    assert main_text(page) == "The first part.\n\nThe second, longer part.\n\nElse"


def test_main_text_by_surge_and_dive():
    page = PAGE % '<div class="content"><h1>Title</h1><p>First <i>para</i>graph, long enough.<div class="ad-box"><p>Buy</p><p>now</p><p>more</p></div><p>Second\n  paragraph &eacute;.</p></div>'
    assert main_text(page) == "Title\n\nFirst paragraph, long enough.\n\nSecond paragraph é."


def _made_page(rng):
    """A page and its main text: what a plain reading of its parts, as they were put together, gives."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    say = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    junk = ["<nav><ul><li><a href=/x>{}</a></ul></nav>", '<div class="ad">{}</div>', "<aside><p>{}</p></aside>", '<div id="cookie-notice">{}</div>', "<form><p>{}</p><input></form>", "<script>var t='<p>{}</p>';</script>", "<!-- <p>{} -->", "<style>p{{{}}}</style>", '<section class="comments"><article><p>{}</p></article></section>', "<div style='display:none'>{}</div>"]
    out, want = [], []

    def block():
        kind = rng.randrange(5)
        text = say(40)
        if kind == 0:
            out.append(f"<h2>{text}</h2>")
        elif kind == 1:
            out.append(f"<ul><li>{text}</li></ul>")
        elif kind == 2:
            more = say(5)
            out.append(f"<p>{text}<br>\n <b>{more}</b> &amp; &lt;i&gt;")
            text = f"{text} {more} & <i>"
        elif kind == 3:
            out.append(f"<div>{text}<p>{text} <a href=q>{text}</a></p></div>")
            want.append(text)
            text = f"{text} {text}"
        else:
            out.append(f"<p>\t{text}\n")
        want.append(text)

    for _ in range(rng.randint(1, 3)):
        out.append(rng.choice(junk).format(say(20)))
        out.append("<article>")
        want.append(say(6))
        out.append(f"<header><h1>{want[-1]}</h1></header>")
        for _ in range(rng.randint(1, 6)):
            block()
            if rng.random() < 0.3:
                out.append(rng.choice(junk[:8]).format(say(20)))
        if rng.random() < 0.3:
            out.append(f"<article><p>{say(9)}</p></article>")
        out.append("</article>")
    out.append(f"<footer><p>{say(30)}</p></footer>")
    page = "<!DOCTYPE html><html><head><title>x</title></head><body><header>Site</header>" + "".join(out) + rng.choice(["", "</body></html>"])
    return page, "\n\n".join(want)


def test_main_text_of_made_pages(spark):
    rng = random.Random(19)
    made = [_made_page(rng) for _ in range(400)]
    for page, want in made:
        assert main_text(page) == want, page
    pages = spark.createDataFrame([(i, "u", page, "x", 3) for i, (page, _) in enumerate(made[:40])] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text(spark, pages).collect())
    assert got == sorted([(i, want, len(want)) for i, (_, want) in enumerate(made[:40])] * 2)


def test_windows_decide_what_is_kept():
    """Three lines of links in an article are a dive of the sums, whatever tag they have; two are not."""
    for tag in ("p", "li", "div"):
        links = [f"<{tag}><a href=x>Link {i}</a></{tag}>" for i in range(4)]
        for n in (2, 4):
            page = "<article><p>Before the links.</p>" + "".join(links[:n]) + "<p>After the links.</p></article>"
            kept = [0, 1] if n == 2 else [0, 3]
            assert main_text(page) == "\n\n".join(["Before the links.", *(f"Link {i}" for i in kept), "After the links."])


def test_pages_without_text(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<nav>x</nav>"), (3, "u", "a < b"), (None, "u", "<p>" + "x" * 300_000)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"][:5], r["n_chars"]) for r in html_text(spark, pages).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "a < b", 5), ("None", "xxxxx", 300_000)]
    assert html_text(spark, pages.limit(0)).collect() == []

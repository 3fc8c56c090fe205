"""Operators on single texts and pages: brute-force twins and odd inputs."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statframe.llm import op1_url_reputation as op1
from statframe.llm import op3_html_suffix_array as op3
from statframe.llm import op6_repair as op6
from statframe.llm import op7_crf_language as op7
from statframe.llm import op8_knn_quality as op8
from statframe.llm import op9_quality_rules as op9
from statframe.llm import op10_sum_of_squares as op10
from statframe.llm import tokens


SF_SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + "\n" + "long line " * 2000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c a b c a b c"), (6, LONG), (7, "same text here"), (7, "same text here"),
       (None, "no id"), (8, "x" * 50_000), (9, "Ünï cödé 漢字 <|endoftext|>  two   three\n\n\nlines \n"), (10, "a\nb\n\na\n b\n")]


def frame(spark, rows=ODD, **extra):
    """Documents with extra columns whose names the operators use themselves."""
    names = ["doc_id", "text", "_gid", "_score", "fp", "score", "host", "n", "k", "piece", "h", "t", "w", "_crf"]
    return spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(names) - 2)]) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))


# ------------------------------------------------------------ 9: rules
def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for ln in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", ln):
            dup += ln in seen
            seen.add(ln)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_rules_match_brute_force(spark):
    rows = [*ODD, (20, "a b c a b c d e f a b c"), (21, "x y x y x y x y"), (22, "l1 a\nl2\nl1 a\n \nl1 a\nl1  a"), (23, "# * $ | < > & %")]
    got = op9.apply_rules(op9.measures(frame(spark, rows))).collect()
    want = collections.Counter((i, *brute_measures(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_on_no_rows(spark):
    assert op9.apply_rules(op9.measures(frame(spark, []))).count() == 0


# -------------------------------------------------------- 1: host reputation
def test_url_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/2", "http://x.net/es/3?q#f", "http://x.net/de/4", "no url", None,
            "http://example.com", "http://notexample.com/en/5", "http://b.www.example.com/en/x#://y/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, mean string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op1.judge(pages, labels).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/2", "example.com/en/", "block"),
        2: ("x.net", "/es/3", "net/es/", "block"), 3: ("x.net", "/de/4", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.com", "", None, "allow"), 7: ("notexample.com", "/en/5", "com/", "allow"),
        8: ("b.www.example.com", "/en/x", "www.example.com/en/", "allow")}


def test_long_urls_repeated_rows_and_no_pages(spark):
    long = "http://" + "a." * 20_000 + "example.com/" + "en/" * 30_000
    rows = [(1, long), (1, long), (None, long), (2, "http://" + "x" * 50_000), (3, "://"), (4, "http:///path"), (5, "ftp://H.COM?q")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = op1.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id == 1} == {"block"}
    assert sum(r.page_id == 1 for r in got) == 2 and {(r.host, r.path) for r in got if r.page_id in (3, 5)} == {("", ""), ("h.com", "")}
    assert [(r.host, r.path) for r in got if r.page_id == 4] == [("", "/path")]
    assert op1.judge(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0


def test_bad_hosts_are_blocked_and_sparse_ones_shrunk(spark):
    rows, labels = [], []
    for h, n, bad in (("bad.example.org", 60, 55), ("good.example.org", 60, 2), ("fresh.example.org", 1, 1), ("fine.other.org", 80, 1)):
        for i in range(n):
            k = len(rows)
            rows.append((k, f"http://{h}/{k}"))
            labels.append((k, int(i >= bad), 0))
    rows.append((len(rows), "http://new.other.org/x"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.host: r for r in op1.judge(pages, lab).dropDuplicates(["host"]).collect()}
    assert got["bad.example.org"].verdict == "block" and got["bad.example.org"].n_good == 5
    assert {got[h].verdict for h in ("good.example.org", "fresh.example.org", "fine.other.org", "new.other.org")} == {"allow"}
    assert got["fresh.example.org"].mean > 0.1  # one bad page is drawn towards the domain
    assert op1.judge(pages.limit(0), lab).count() == 0


# --------------------------------------------------------------- 3: html
def test_blocks_of_an_article():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a href="/x">Menu</a></nav>
<div id="cookie-notice">Cookies</div><div class=ad>Buy</div><main><article class="post"><h1>Head &amp; line</h1><p>First <b>bold</b>
 line<br>goes&nbsp;on<p class="notice">Notice<p>Second<ul><li>one<li>two</ul><form>f<input></form><section id="comments"><p>c</p></section>
<script>if (a < b) { "</p>" }</script><!-- note --></article><aside>Side</aside></main><footer>&copy; F</footer><p hidden>h</p>end <trunc"""
    assert op3.main_text(op3.read_blocks(page)) == "Head & line\n\nFirst bold line goes on\n\nSecond\n\none\n\ntwo"
    assert op3.read_blocks("") == [] and op3.main_text([]) is None


def test_articles_beside_the_text_and_in_main():
    read = lambda page: op3.main_text(op3.read_blocks(page))
    assert read("<main><p>Long main prose goes here</p><article class='card'>Only card</article></main>") == "Long main prose goes here\n\nOnly card"
    assert read("<main><div>Share</div><article><h1>Head</h1><p>Story of the page</p></article></main>") == "Head\n\nStory of the page"
    page = "<article><p>Story</p><div class='related'><article>Teaser one</article></div></article><div class=related><article>Teaser two</article></div>"
    assert read(page) == "Story"
    assert read("<div class='page sidebar-left'><article>Story<p class=ad>Buy</p></article></div>") is not None
    assert read("<div class=related><article>Teaser</article></div><main><p>Prose</p></main>") == "Prose"
    deep = "<div>" * 3000 + "<article><p>" + "long " * 200_000 + "</p></article>" + "</div>" * 3000
    assert read(deep) == ("long " * 200_000).strip()


def test_repeated_runs_of_a_host_go_and_unique_text_stays(spark):
    foot = "All rights reserved by the example company of this site and its partners"
    rows = [(i, "http://a.example.com/x", f"<body><div>{foot}</div><div>Unique text number {i} with words w{i} v{i} u{i} and so on</div><div>Home</div>", "x")
            for i in range(12)]
    rows += [(0, *rows[0][1:]), (20, None, None, "x"), (21, "http://b.c/", "", "x"), (22, "http://b.c/", f"<div>{foot}</div>", "x"),
             (30, "http://a.example.com/y", f"<article><p>{foot}</p></article>", "x"), (None, "http://q.r/", "<p>null id", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _rid string")
    for chunk in (40, 100_000):  # the result does not depend on the chunking
        got = collections.Counter((r.page_id, r.text, r["_rid"]) for r in op3.extract(pages, chunk_tokens=chunk).collect())
        want = collections.Counter([(i, f"Unique text number {i} with words w{i} v{i} u{i} and so on", "x") for i in [0, *range(12)]]
                                   + [(20, "", "x"), (21, "", "x"), (22, foot, "x"), (30, foot, "x"), (None, "null id", "x")])
        assert got == want
    assert op3.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    foot = "All rights reserved by the example company of this site and its partners"
    body = "One story that the host serves under many ids and addresses with its whole text"
    rows = [(i, f"http://a.example.com/{i}", f"<body><div>{foot}</div><p>{body}</p>") for i in range(5)]  # copies under other ids
    rows += [(10 + i, "http://a.example.com/x", f"<body><div>{foot}</div><p>Story number {i} of w{i} v{i}</p>") for i in range(3)]
    # boilerplate of pages that differ in their articles only still counts once for each of them
    rows += [(20 + i, "http://b.example.com/x", f"<article><p>Article {i}</p></article><div>{foot}</div>") for i in range(3)]
    rows += [(30, "http://b.example.com/y", f"<p>{body}</p><div>{foot}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (20, 100_000):
        got = {r.page_id: r.text for r in op3.extract(pages, chunk_tokens=chunk).collect()}
        assert got == {**{i: body for i in range(5)}, **{10 + i: f"Story number {i} of w{i} v{i}" for i in range(3)},
                       **{20 + i: f"Article {i}" for i in range(3)}, 30: body}


def test_repeated_articles_beside_the_longest_go(spark):
    card = "Read the ten stories that all our readers liked best in this year"
    story = lambda i: f"Story number {i} with the words w{i} v{i} u{i} told in full and to its very end today"
    rows = [(i, "http://a.example.com/x", f"<article><p>{story(i)}</p></article><article><p>{card}</p></article>") for i in range(4)]
    rows += [(10, "http://a.example.com/x", f"<article><p>{card}</p></article>"),  # the only part stays
             (11, "http://a.example.com/x", f"<main><p>{story(11)}</p><article>{card} and more</article></main>"),  # own words: stays whole
             (12, "http://a.example.com/x", f"<article><p>{card}</p></article>" * 2),  # half of the text: stays
             (20, "http://b.example.com/x", f"<article><p>{story(20)}</p></article><article><p>{card}</p></article>")]  # once on its host
    rows += [(30 + i, "http://c.example.com/x", f"<nav>n{i}</nav><article><p>{story(0)}</p></article><article><p>Own {i}</p></article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (20, 100_000):
        got = {r.page_id: r.text for r in op3.extract(pages, chunk_tokens=chunk).collect()}
        assert got == {**{i: story(i) for i in range(4)}, 10: card, 11: f"{story(11)}\n\n{card} and more", 12: f"{card}\n\n{card}",
                       20: f"{story(20)}\n\n{card}", **{30 + i: f"{story(0)}\n\nOwn {i}" for i in range(4)}}


def test_notices_inside_the_article_of_most_pages_go(spark):
    notice = "Follow our letter of the week and never miss a story from us again"
    law = "This text may be copied under the terms of the licence by all of you"
    story = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    page = lambda *blocks, more="": "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</article>{more}"
    url = lambda h: f"http://{h}.example.com/x"
    rows = [(i, url("a"), page("Head", story(i), notice)) for i in range(14)]
    rows += [(50 + i, url("a"), rows[0][2]) for i in range(3)]
    rows += [(20 + i, url("a"), page(f"Head {i}", story(20 + i), law)) for i in range(10)]  # ten pages, but not most of them
    rows += [(30, url("a"), page(story(30), notice + " said v30")), (31, url("a"), page("Short", notice))]  # own words; half of the text
    rows += [(100 + i, url("b"), page(story(100 + i), notice)) for i in range(9)]  # too few pages
    rows += [(110 + i, url("c"), page(story(110), f"own {i} u{i} v{i}")) for i in range(12)]  # the same article
    rows += [(130 + i, url("d"), page(story(130 + i), more=f"<footer>{notice}</footer>")) for i in range(12)] + [(142, url("d"), page(story(142), notice))]
    rows += [(150 + i, url("e"), page(story(0), more="<div>Menu</div>")) for i in range(20)]  # copies are one page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Head\n\n{story(i)}" for i in range(14)} | {50 + i: f"Head\n\n{story(0)}" for i in range(3)}
    want |= {20 + i: f"Head {i}\n\n{story(20 + i)}\n\n{law}" for i in range(10)}
    want |= {30: f"{story(30)}\n\n{notice} said v30", 31: f"Short\n\n{notice}"} | {100 + i: f"{story(100 + i)}\n\n{notice}" for i in range(9)}
    want |= {110 + i: f"{story(110)}\n\nown {i} u{i} v{i}" for i in range(12)} | {130 + i: story(130 + i) for i in range(13)} | {150 + i: story(0) for i in range(20)}
    for chunk in (60, 700, 100_000):
        got = {r.page_id: r.text for r in op3.extract(pages, chunk_tokens=chunk).collect()}
        assert got == want


def test_chunk_runs_match_brute_force():
    rng = np.random.default_rng(5)
    block = lambda: " ".join(rng.choice(["a", "b"], rng.integers(1, 9)))
    pages = [([block() for _ in range(rng.integers(0, 4))], [block() for _ in range(rng.integers(0, 4))]) for _ in range(30)]
    for depth in (1, 3, 5):
        runs = [[{int(k) for b in blocks for k in op3.run_keys(op3.token_hashes(b), depth)} for blocks in page] for page in pages]
        whole = [[{int(k) for b in blocks if len(b.split()) >= depth for k in op3.run_keys(op3.token_hashes(b), depth)} for blocks in page] for page in pages]
        beside, every = collections.Counter(k for x, _ in runs for k in x), collections.Counter(k for x, y in whole for k in x | y)
        (k, n), (k2, n2, main) = op3.chunk_runs(pages, depth)
        assert dict(zip(k.tolist(), n.tolist())) == beside and len(k) == len(beside)
        assert dict(zip(k2.tolist(), n2.tolist())) == every and len(k2) == len(every)
        assert set(k2[main].tolist()) == {x for _, y in whole for x in y}


def test_suffix_groups_match_brute_force():
    rng = np.random.default_rng(3)
    for depth in (2, 3, 5, 8):
        t = rng.integers(0, 3, 200).astype(np.uint64)
        order, rank = op3.suffix_groups(t, depth)
        runs = [tuple(t[i:i + depth]) for i in range(len(t))]
        assert [runs[i] for i in order] == sorted(runs)
        assert all((rank[i] == rank[j]) == (runs[i] == runs[j]) for i in range(0, 200, 7) for j in range(200))


# ------------------------------------------------- tokens, 6: Re-Pair, 10: packing
def test_pieces_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(1)
    parts = ["a", "The", "then", "'s", " ", "  ", "   ", "\n", "\n\n", " \n", ".", ",", "...", "5", "é", "漢字", "\t", "|", "&", "<|endoftext|>", "\x00", "\x01", " the", " "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(3000)] + [None, "", "x" * 500, LONG]
    t = tokens.PieceTokenizer(tokens.vocabulary_path())
    count, ids = t.encode(pa.array(texts, pa.string()))
    fresh = Tokenizer.from_file(tokens.vocabulary_path())  # the contract's own call
    want = [[*fresh.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert fresh.encode("a<|endoftext|>", add_special_tokens=False).ids == t.encode(pa.array(["a<|endoftext|>"]))[1].tolist()[:-1]
    assert count.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    t.rest(40)  # a trimmed memo gives the same ids, again after new pieces
    assert len(t.code) == 42
    for _ in range(2):
        assert t.encode(pa.array(texts, pa.string()))[1].tolist() == ids.tolist()


def test_odd_characters_beside_cuts_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(7)
    parts = ["a", "The", "'s", "'", " ", "\n", " \n", ".", ",", "?", "42", "é", "É", "ñ", "×", "÷", "Ω", "漢字", "。", "🙂", "１", "٣", "ɏ", "ɐ", "e\u0301",
             "\u00ad", "$$$", "&&", "_", "-", "\x7f", "\u200b", "’s", "ß!", "\U0001d400", "\U0001d7d8", "AKIA6X"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(6000)]
    t = tokens.PieceTokenizer(tokens.vocabulary_path())
    fresh = Tokenizer.from_file(tokens.vocabulary_path())
    want = [[*fresh.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    for kind in (pa.string(), pa.large_string()):
        count, ids = t.encode(pa.array(["not this one", *texts], kind).slice(1))
        assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    for texts in ([], [""], ["", "a", ""]):
        count, ids = t.encode(pa.array(texts, pa.string()))
        assert count.tolist() == [1 + len(x) for x in texts] and len(ids) == count.sum()


def test_words_marks_and_line_starts_go_straight_to_the_merges(monkeypatch):
    t = tokens.PieceTokenizer(tokens.vocabulary_path())
    long_way, ids = [], t.ids
    monkeypatch.setattr(t, "ids", lambda texts: long_way.extend(texts) or ids(texts))
    text = "One two$$$ three.42@mail1, four\nFive éàö%% AKIA6X6 7.5 (six)\nseven"
    assert t.encode(pa.array([text]))[1].tolist() == [*Tokenizer.from_file(tokens.vocabulary_path()).encode(text, add_special_tokens=False).ids, 0]
    assert [x for x in long_way if x.strip()] == []


def test_repair_looks_up_pairs_beside_replaced_places_only(monkeypatch):
    x = np.random.default_rng(8).zipf(1.3, 60_000).clip(1, 5000).astype(np.uint32)
    looked, numbered = [], op6._numbered
    monkeypatch.setattr(op6, "_numbered", lambda keys: looked.append(len(keys)) or numbered(keys))
    s, r = op6.compress(x, round_rules=16)
    assert len(looked) > 30 and (op6.expand(s, r) == x).all()
    assert sum(looked) < 3 * len(x)  # not the whole shard again in every round


def test_repair_of_overlapping_pairs_is_the_greedy_one():
    rng = np.random.default_rng(9)
    for _ in range(300):
        at = np.flatnonzero(rng.random(60) < 0.8)
        r = rng.integers(0, rng.integers(1, 8), len(at))
        gone, want = set(), set()
        for _, p in sorted(zip(r.tolist(), at.tolist())):
            if not {p, p + 1} & gone:
                want.add(p)
                gone |= {p, p + 1}
        assert set(at[op6._apart(at, r)].tolist()) == want
    x = rng.integers(0, 12, 20_000).astype(np.uint32)
    _, rules = op6.compress(x, round_rules=32)
    assert len(np.unique(rules, axis=0)) == len(rules)  # a pair has one rule


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for _ in range(100):
        x = rng.integers(0, rng.integers(2, 30), rng.integers(1, 400)).astype(np.uint32)
        s, r = op6.compress(x, min_count=2)
        assert (op6.expand(s, r) == x).all()
        shard = {"symbols": s, "rules": r, "lengths": op6.rule_lengths(r).astype(np.uint32)}
        a, b = sorted(rng.integers(0, len(x) + 1, 2).tolist())
        if a < b:
            assert (op6.id_range(shard, a, b) == x[a:b]).all()
        assert not ((r == 0).any())  # the end id is in no rule
    x = np.tile(np.arange(1, 9, dtype=np.uint32), 5000)
    s, r = op6.compress(x)
    assert len(s) < 20 and (op6.expand(s, r) == x).all()  # rounds go on: the tile is doubled up
    s, r = op6.compress(np.full(100_000, 7, np.uint32))
    assert len(s) < 40 and len(op6.expand(s, r)) == 100_000


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    x = rng.zipf(1.3, 60_000).clip(1, 5000).astype(np.uint32)
    s, r = op6.compress(x)
    pairs = s[:-1].astype(np.uint32) << 16 | s[1:]
    assert len(r) == op6.MAX_RULES or op6._frequent(pairs, 10, op6.MIN_COUNT).size == 0
    one_by_one, _ = op6.compress(x, round_rules=16)
    assert len(s) < 1.02 * len(one_by_one)


def test_repeated_rows_are_split_between_files(spark, tmp_path):
    rows = [(3, "same text of a third of all rows")] * 200 + [(i, f"text {i}") for i in range(400)]
    op6.write_ids(frame(spark, rows).repartition(4), str(tmp_path / "ids"), shard_ids=200)
    files = spark.read.parquet(str(tmp_path / "ids"))
    per_part = [r.n for r in files.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert len(per_part) == 4 and max(per_part) < 300
    got = op6.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)


def expected_ids(rows):
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows]


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_id_files(spark, tmp_path, shard_ids):
    op6.write_ids(frame(spark), str(tmp_path / "ids"), shard_ids=shard_ids)
    got = sorted(op6.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    want = collections.Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(ODD, expected_ids(ODD)))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in ODD)
    assert [r.start for r in got] == list(np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]])
    op6.write_ids(frame(spark, []), str(tmp_path / "none"))
    assert op6.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_sum_of_squares_rule_matches_brute_force():
    rng = np.random.default_rng(2)
    cap = 20
    for _ in range(30):
        items = rng.integers(1, cap + 1, 60)
        where, offset, gaps = op10.sum_of_squares(items, cap)
        bins = []
        for i, s in enumerate(items.tolist()):
            def cost(b):
                g = list(bins) if b < len(bins) else [*bins, cap]
                g[b] -= s
                return sum(v * v for k, v in collections.Counter(g).items() if k)
            options = [b for b in range(len(bins) + 1) if (bins[b] if b < len(bins) else cap) >= s]
            least = min(map(cost, options))
            b = int(where[i])
            assert b in options and cost(b) == least
            if b == len(bins):
                bins.append(cap)
            assert offset[i] == cap - bins[b]
            bins[b] -= s
        assert bins == gaps.tolist()


def test_packing(spark):
    for shard in (4, 10_000):
        got = op10.pack(frame(spark), capacity=512, shard_pieces=shard).toPandas()
        ids = expected_ids(ODD)
        assert got["length"].sum() == sum(map(len, ids)) and got["length"].max() <= 512
        at = got.sort_values(["sequence_id", "offset"])
        assert (at["offset"] == at.groupby("sequence_id")["length"].cumsum() - at["length"]).all()
        assert at.groupby("sequence_id")["length"].sum().max() <= 512
        assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 512) + 2
        want = collections.Counter()
        for r, x in zip(ODD, ids):
            s = 0
            for k, m in enumerate(op10.piece_lengths(len(x), 512)):
                want[r[0], k, s, m, zlib.crc32(x[s:s + m].tobytes())] += 1
                s += m
        assert collections.Counter((None if i != i else int(i), p, s, m, c) for i, p, s, m, c in
                                   got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    assert op10.pack(frame(spark, [])).count() == 0
    assert op10.piece_lengths(2048, 2048) == [2048] and op10.piece_lengths(2049, 2048) == [1, 2048]


# ----------------------------------------------------- 7: language, 8: quality
def test_forward_backward_matches_enumeration():
    import itertools
    rng = np.random.default_rng(4)
    k, n = 3, 5
    crf = op7.Crf(["a", "b", "c"], np.zeros((op7.DIMS, k)), rng.normal(size=(k, k)), rng.normal(size=k), {}, np.zeros((0, k)), 0.0)
    em = rng.normal(size=(n + 2, k))
    marg, pairs, first = op7.forward_backward(em, np.array([0, n]), np.array([n, 2]), crf)
    total, want, wp = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(crf.start[path[0]] + sum(em[t, path[t]] for t in range(n)) + sum(crf.trans[a, b] for a, b in zip(path, path[1:])))
        total += p
        want[np.arange(n), path] += p
        for a, b in zip(path, path[1:]):
            wp[a, b] += p
    assert np.allclose(marg[:n], want / total)
    assert np.allclose(pairs.sum(), n - 1 + 1) and np.allclose(first.sum(), 2)


def test_chains_overlap_inside_their_text_only():
    rows = np.repeat([0, 1, 2], [5, 64, 150])
    start, length, left, n = op7.overlapped(rows, 64, 8)
    assert list(zip(start, length, left, n)) == [(0, 5, 0, 5), (5, 64, 0, 64), (69, 72, 0, 64), (125, 80, 8, 64), (189, 30, 8, 22)]
    # the overlap carries messages: marginals near a cut are those of the uncut chain
    rng = np.random.default_rng(4)
    crf = op7.Crf(["a", "b"], np.zeros((op7.DIMS, 2)), np.array([[2.0, -1.0], [-1.0, 2.0]]), np.zeros(2), {}, np.zeros((0, 2)), 0.0)
    em = rng.normal(size=(150, 2))
    whole = op7.forward_backward(em, np.array([0]), np.array([150]), crf)[0]
    s, ln, lf, m = op7.overlapped(np.zeros(150, np.int64), 64, 8)
    begin = np.cumsum(ln) - ln
    word = np.repeat(s - begin, ln) + np.arange(ln.sum())
    own = np.repeat(begin + lf - (np.cumsum(m) - m), m) + np.arange(150)
    parts = op7.forward_backward(em[word], begin, ln, crf)[0][own]
    cut = op7.forward_backward(em, *op7.chains_of(np.zeros(150, np.int64), 64), crf)[0]
    assert np.abs(parts - whole).max() < 0.02 < np.abs(cut - whole).max()


def test_language(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    crf = op7.fit(docs.select("doc_id", "text", "lang"))
    pred = op7.detect(docs, crf).where("crc32(cast(doc_id as string)) % 4 = 2").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in pred]) > 0.95
    odd = {r.doc_id: r for r in op7.detect(frame(spark), crf).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[1].score == 0.0 and odd[1]["_crf"] == "x11"
    assert op7.detect(frame(spark, [(1, "12 3 ... $$")]), crf).first().lang_pred == "und"
    texts = {lang: docs.where(f"lang = '{lang}'").first().text for lang in ("en", "de")}
    share = op7.language_shares(crf, pa.array([" ".join(texts["en"].split()[:40] + texts["de"].split()[:40])]))[0][0]
    assert 0.2 < share[crf.langs.index("en")] < 0.8 and 0.2 < share[crf.langs.index("de")] < 0.8  # code-switched
    # letters are category L alone
    assert [r.lang_pred for r in op7.detect(frame(spark, [(1, "\u00b2\u00b3 \u00bd \u2167 \u0661 _")]), crf).collect()] == ["und"]
    assert op7.letters_of(["\u00bd", "a\u00b2b", "\u2167", "\u00c9t\u00e9", "\u6f22"]) == ["", "ab", "", "\u00e9t\u00e9", "\u6f22"]
    assert op7.detect(frame(spark, []), crf).count() == 0
    twice = op7.detect(frame(spark, [(1, texts["en"]), (1, texts["en"])]), crf).collect()
    assert twice[0].score == twice[1].score and twice[0].lang_pred == "en"
    none = op7.fit(docs.limit(0).select("doc_id", "text", "lang"))
    assert op7.detect(frame(spark, [(1, "text")]), none).first().lang_pred == "und"


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = op8.fit(docs, labels, max_labelled=1500)
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0").join(docs, "doc_id")
    got = op8.classify(held, model).select("quality", "predicted", "score").toPandas()
    assert (got.predicted[got.quality == 1] == 1).mean() > 0.98 and (got.predicted[got.quality == 0] == 0).mean() > 0.9
    odd = op8.classify(frame(spark), model).select("doc_id", "score", "predicted", "_score").collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert {r.score for r in odd if r.doc_id in (1, 2, 3)} == {model.prior}
    kept = op8.keep_good(frame(spark), model)
    assert kept.columns == frame(spark).columns
    none = op8.fit(docs.limit(0), labels)
    assert op8.classify(frame(spark, [(1, "text")]), none).first().predicted == 1
    # votes are exact: those of a full sort of all cosine products, whichever of the neighbours that are
    # equally near at the k-th place speak
    x = model.vectors[:80]
    sim = (x @ model.vectors.T).astype(np.float64)
    for i, got_score in enumerate(model.vote(x)):
        edge = np.sort(sim[i])[-model.k]
        sure, tied = sim[i] > edge + 1e-6, np.abs(sim[i] - edge) <= 1e-6
        ends = []
        for first in (0, 1):  # tied neighbours of label 0, or of label 1, come first
            order = np.argsort(model.labels[tied] != first, kind="stable")[:model.k - sure.sum()]
            near = np.r_[np.flatnonzero(sure), np.flatnonzero(tied)[order]]
            w = np.where(sim[i][near] < op8.MIN_SIMILARITY, 0, sim[i][near])
            ends.append((w * model.labels[near]).sum() / w.sum())
        assert min(ends) - 1e-5 <= got_score <= max(ends) + 1e-5
    # repeated rows score alike; ties between texts do not depend on the order
    twice = op8.classify(frame(spark, [(1, "some text here"), (1, "some text here"), (2, "some text here")]), model).collect()
    assert len({r.score for r in twice}) == 1

"""Spelling variants, fill-in-middle and exact dedup: brute-force twins, round trips and odd inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statframe.llm import op11_spelling_variants as op11
from statframe.llm import op12_piece_table_fim as op12
from statframe.llm import op13_chunk_recipes as op13

SF_SMALL = "/root/testdata/sf0.001"
CLASH = ["h", "run", "word", "n", "key", "id", "output", "form", "_fim", "row", "recipe", "_no", "top"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{n} string" for n in CLASH))


# ----------------------------------------------------- 11: spelling variants
def brute_words(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (words[w], form[w], words[form[w]] if form[w] else None, len(near[w]), r)
    return out


def groups_of(df):
    rows = df.select("word", "n", "form", "form_n", "n_near", "root").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_variants_match_brute_force(spark):
    rnd = random.Random(5)
    base = ["Reading", "garden", "Straße", "élevage", "ananas", "bananas", "aaaaaa", "x" * 60, "çççççç×÷"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rnd.randrange(1, 40)):
            w = rnd.choices(base, [40, 30, 20, 20, 9, 9, 9, 9, 4])[0]
            if rnd.random() < .3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + "ae"[i % 2] + w[k:], w[:k] + "O" + w[k + 1:]])
            words.append(w)
        rows.append((i if i % 50 else None, rnd.choice([" ", ", ", "1", "_"]).join(words)))
    rows += [(7, None), (8, ""), (9, "12 -- ,"), rows[3], rows[3], (10, "é" * 2000 + " " + "é" * 2001)] + [(j, "é" * 2000 + " " + "é" * 1999 + "a") for j in range(20, 30)]
    got = groups_of(op11.spelling_variants(frame(spark, rows)))
    words = brute_words(rows)
    assert got == brute_groups(words)
    assert sum(f is not None for _, f, *_ in got.values()) > 20
    # words too long to travel with their neighbours, and a coarser alphabet, give the same
    vocab = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert groups_of(op11.variant_groups(vocab, symbols=2)) == got
    for inline in (0, 8):
        v = op11._kept(vocab.withColumn("id", F.monotonically_increasing_id()), "words")
        pairs = {(r["word"], r["near"]) for r in op11.near_words(v, inline=inline).collect()}
        assert pairs == {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}


def test_form_ties_chains_and_empty_tables(spark):
    vocab = [("abcdef", 10000), ("abcdeg", 1000), ("abcdhg", 100), ("abcihg", 10), ("kbcdef", 10), ("kbcdeg", 1999), ("zzzzzz", 5),
             ("zzzzza", 25), ("zzzzzb", 25), ("alone-", 7)]
    got = groups_of(op11.variant_groups(spark.createDataFrame(vocab, "word string, n long")))
    assert got == brute_groups(dict(vocab))
    assert got["abcihg"][4] == "abcdef" and got["zzzzzz"][1] == "zzzzza"
    assert op11.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbour_keys_are_the_full_neighbourhood():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 6, 9):
        s = rnd.integers(1, 4, n).astype(np.uint64)
        want = {tuple(s)}
        for i in range(n):
            want.add(tuple(np.delete(s, i)))
            want |= {tuple(np.r_[s[:i], [c], s[i + 1:]]) for c in (1, 2, 3)}
        for i in range(n + 1):
            want |= {tuple(np.r_[s[:i], [c], s[i:]]) for c in (1, 2, 3)}
        keys = {int(op11.reduced_key(np.array(w, np.uint64))) for w in want}
        assert len(keys) == len(want) and keys == set(op11.neighbour_keys(s, 3).tolist())


def test_variants_on_documents(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    got = groups_of(op11.op11_spelling_variants(spark, SF_SMALL))
    assert {w: v[0] for w, v in got.items()} == brute_words(rows)
    assert got == brute_groups(brute_words(rows))


# -------------------------------------------------------- 12: fill-in-middle
def brute_fim(i, t):
    t = t or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "a", "<", "<P", "P><S", "a<P>b", "<M>", "é", "日本語" * 40, "a\U0001f600b" * 30, "x" * 200_000, "ü" * 100_000, "\x00\n\t", "<<S><", "</M>" * 9]


def test_fim_matches_definition_and_restores(spark):
    rows = [(i, ODD[i % len(ODD)]) for i in range(400)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    want = sorted([(i, *brute_fim(i, t)[:4], sha(brute_fim(i, t)[4]), sha(t or "")) for i, t in rows], key=key)
    got = sorted([tuple(r) for r in op12.fim_digests(frame(spark, rows)).collect()], key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    out = op12.fill_in_middle(frame(spark, rows))
    assert out.columns[:len(CLASH) + 2] == ["doc_id", "text", *CLASH]
    back = out.withColumn("back", op12.restored_text("output_", "form_")).select("doc_id", "text", "output_", "back").collect()
    assert len(back) == len(rows)
    for i, t, o, b in back:
        assert o == brute_fim(i, t)[4] and b == (t or "")
    assert op12.fim_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_share_their_buffers():
    text = ("é<b" * 50).encode()
    for i in range(200):
        pieces, _, form, _, _ = op12.arrange(text, i)
        own = [p for p in pieces if p.buffer.obj is text]
        assert sum(p.length for p in own) == len(text)
        out = op12.joined(pieces)
        assert op12.joined(op12.restore(out, form)) == text


# ------------------------------------------------------------ 13: exact dedup
def brute_copies(rows):
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[t or ""].append((i is not None, i, k))
    out = []
    for t, g in groups.items():
        ids = [i for _, i, _ in g if i is not None]
        keep = max(ids, default=None)
        out += [(i, keep, len(g), hashlib.sha256(t.encode()).hexdigest()) for _, i, _ in g]
    return sorted(out, key=str)


def copies(rnd):
    long = "".join(rnd.choice("abcdefgh \n") for _ in range(200_000))
    base = ["", None, "short", "short ", "é" * 5000, long, long[:-1], long + "x", "y" + long, long[:100_000] + "#" + long[100_000:], "z" * 300_000]
    rows = [(i, rnd.choice(base)) for i in range(120)] + [(i, "hot") for i in range(200, 300)]
    return rows + [(None, "no id"), (None, "no id"), (None, "short"), (7, "again"), (7, "again"), (7, "other")]


def check_copies(got, rows):
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute_copies(rows)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_copies_match_brute_force(spark):
    rows = copies(random.Random(2))
    check_copies(op13.copy_groups(frame(spark, rows).repartition(5)).collect(), rows)
    # every group through the shuffled join, and every group through the broadcast one
    for heavy in (1, 10 ** 6):
        check_copies(op13.copy_groups(frame(spark, rows), heavy_groups=heavy).collect(), rows)
    assert op13.copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    left = op13.drop_copies(frame(spark, rows))
    assert left.columns == ["doc_id", "text", *CLASH]
    assert collections.Counter(r["text"] or "" for r in left.select("text").collect()) == collections.Counter({t or "" for _, t in rows})


def test_hash_collisions_are_told_apart(spark):
    """With 4-bit hashes nearly all chunks collide: the contents decide."""
    rows = copies(random.Random(4)) + [(1000 + i, f"tiny {i % 40}") for i in range(80)]
    d = frame(spark, rows)
    assert op13.clashing_chunks(d, bits=4).select("name").distinct().count() > 4
    check_copies(op13.copy_groups(d, bits=4).collect(), rows)


def test_chunks_follow_content():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 123, 300_000).astype(np.uint8).tobytes()
    (raw, ends), (raw2, ends2) = op13.chunks_of(pa.array([text, b"head" + text[:150_000] + b"middle" + text[150_000:]]))
    assert ends[-1] == len(text) and bytes(raw) == text
    sizes = np.diff([0, *ends])
    assert sizes.max() <= op13.MAX_CHUNK and sizes[:-1].min() >= op13.MIN_CHUNK and 1000 < sizes.mean() < 4000
    cut = lambda r, e: {bytes(r[a:b]) for a, b in zip([0, *e], e)}
    assert len(cut(raw, ends) & cut(raw2, ends2)) > .9 * len(ends)  # an edit changes the chunks around it only
    # blocks of the rolling hash join without a seam
    data = np.frombuffer(text, np.uint8)
    whole = np.flatnonzero(op13.rolling_hash(data) >> np.uint64(53) == 0) + 1
    block, op13.BLOCK = op13.BLOCK, 1000
    try:
        assert op13.marked_ends(data, op13.MEAN_CHUNK).tolist() == whole.tolist()
    finally:
        op13.BLOCK = block

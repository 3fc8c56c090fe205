"""Operators across documents and the pipeline: brute-force twins and odd inputs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from statframe.llm import op2_cgk_decontamination as op2
from statframe.llm import op4_line_windows as op4
from statframe.llm import op5_simhash as op5
from statframe.llm import op8_knn_quality as op8
from statframe.llm import op10_sum_of_squares as op10

SF_SMALL = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba de fi go lu mi no pe ra su".split() for b in "lor nim tas vek dun".split()]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(n))


def frame(spark, rows):
    names = ["_gid", "_gone", "_hit", "_rank", "h1", "occ", "fp", "key", "n_chars"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


# ------------------------------------------------------------ 4: line windows
def brute_lines(rows):
    """Text of each row without later three-line windows, rows in (doc_id, text hash) order of first sight."""
    wins, solid = collections.defaultdict(list), {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        ls = (rows[k][1] or "").split("\n")
        nb = [(i, x.strip(" \t\x0b\f\r")) for i, x in enumerate(ls) if x.strip(" \t\x0b\f\r")]
        solid[k] = [(tuple(x for _, x in nb[j:j + 3]), nb[j][0], nb[j + 2][0]) for j in range(len(nb) - 2)]
        for w, lo, hi in solid[k]:
            wins[w].append((k, lo, hi))
    out = []
    for k, (i, t) in enumerate(rows):
        if t is None:
            out.append((i, None))
            continue
        gone = set()
        for w, lo, hi in solid[k]:
            fk, flo, fhi = wins[w][0]
            if rows[fk] == rows[k]:
                if lo == flo:
                    continue
                lo = max(lo, fhi + 1)
            gone |= set(range(lo, hi + 1))
        out.append((i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)))
    return out


def test_line_windows_match_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "x" * 3000]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12)))) for i in range(150)]
    rows += [(900, "same\n" * 40), (901, "a\nb\nc\nd"), (901, "a\nb\nc\nd"), (902, " a \nb\n\n \nc\nq"), (None, "a\nb\nc"), (903, None), (904, "")]
    rows += [(905, "\n".join(f"long {i}" for i in range(5000))), (906, "\n".join(f"long {i}" for i in range(5000)) + "\nend")]
    got = op4.dedup_lines(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(brute_lines(rows))
    assert op4.dedup_lines(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 5: simhash
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    lab = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and lab[i] != lab[j]:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    return lab


def near_rows():
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 120)) for i in range(60)]
    for i in range(60, 140):
        w = rows[rnd.randrange(20)][1].split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "ONE  two"), (205, "é É"), (206, "É É"), (7, rows[7][1]), (300, prose(rnd, 40_000))]


def test_simhash_matches_brute_force(spark):
    rows = near_rows()
    got = collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in op5.near_duplicates(frame(spark, rows)).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    lab = brute_components(fps)
    least = {g: min(rows[k][0] for k in range(len(rows)) if lab[k] == g) for g in lab}
    assert got == collections.Counter((i, f, least[g]) for (i, _), f, g in zip(rows, fps, lab))
    kept = op5.keep_one(frame(spark, [*rows, (None, "no id"), (None, "no id")]))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 2
    assert op5.near_duplicates(frame(spark, [])).count() == 0


def test_tiles_and_small_buckets_find_the_same_components(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = [int(base[k % 6]) for k in range(400)]
    for k in range(400):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            fps[k] ^= 1 << int(b)
    fps = np.array(sorted(set(fps)), np.uint64)
    want = brute_components([int(x) for x in fps])
    for radius in (1, 2, 3, 5):
        w = brute_components([int(x) for x in fps], radius)
        assert op5.components_in_bucket(fps, radius).tolist() == w
        a, b = op5.links_in_rows(fps, np.full(len(fps), len(fps)), radius)
        assert op5.local_components(len(fps), a, b).tolist() == w
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for tile in (16, 4096):
        roots = {r.node: r.root for r in op5.components(op5.fingerprint_links(df, 3, tile)).collect()}
        got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
        assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))


# -------------------------------------------------------- 2: decontamination
def edited(rnd, words, k):
    w = list(words)
    for _ in range(k):
        op, j = rnd.random(), rnd.randrange(len(w))
        if op < 0.6:
            w[j] = rnd.choice(WORDS)
        elif op < 0.8 and len(w) > 1:
            del w[j]
        else:
            w.insert(j, rnd.choice(WORDS))
    return w


def test_recall_and_exactness_of_the_search():
    rnd = random.Random(6)
    items = [prose(rnd, rnd.randrange(8, 70)) for _ in range(150)]
    walks = op2.index_items(list(range(150)), items)
    for rate in (0.0, 0.1, 0.2):
        texts = []
        for t in items:
            w = t.split()
            texts.append(prose(rnd, rnd.randrange(50)) + " " + " ".join(edited(rnd, w, int(rate * len(w)))) + " " + prose(rnd, rnd.randrange(50)))
        hits = op2.find_items(walks, pa.array(texts))
        assert len({(r, i) for r, i, *_ in hits if r == i}) >= 0.95 * 150  # target recall
        for r, i, d, first, n in hits:
            a, b = op2.word_hashes(items[i].split()), op2.word_hashes(texts[r].split())
            assert d == int(op2._edit_ends(a, b[first:first + n], False)[-1]) <= 0.2 * len(a)


def test_items_within_their_edits_are_found_at_every_length():
    rnd = random.Random(12)
    for lo, hi in ((5, 9), (10, 13), (14, 17), (18, 40)):
        items = [prose(rnd, rnd.randint(lo, hi)) for _ in range(200)]
        texts = [" ".join([prose(rnd, 30), *edited(rnd, t.split(), int(0.2 * len(t.split()) + 1e-9)), prose(rnd, 30)]) for t in items]
        hits = op2.find_items(op2.index_items(list(range(200)), items), pa.array(texts))
        found = len({r for r, i, *_ in hits if r == i})
        assert found == 200 if hi < op2.SHORT else found >= 0.98 * 200, (lo, hi, found)
        # the walks are what finds them
        assert not op2.find_items(op2.index_items(list(range(200)), items, tables=0), pa.array(texts))


def test_edit_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i] + [0] * len(b), d
            for j, y in enumerate(b, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y))
        return d
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        assert op2._edit_ends(a, b, False).tolist() == slow(a, b)
        best = min(slow(a, b[s:e])[-1] for s in range(len(b) + 1) for e in range(s, len(b) + 1))
        d, s, e = op2.align(a, b)
        assert d == best == slow(a, b[s:e])[-1]


def test_contaminations(spark):
    rnd = random.Random(9)
    item = prose(rnd, 30)
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, prose(rnd, 20), "x"), (6, item, "x")],
                                  "item_id long, text string, doc_id string")
    rows = [(1, prose(rnd, 20) + " " + item.upper() + ", " + prose(rnd, 10)), (2, prose(rnd, 100)), (3, None), (4, ""), (None, item), (5, item), (5, item),
            (6, prose(rnd, 30_000) + "\n" + item + " " + prose(rnd, 30_000)), (7, "too short"), (8, " ".join(item.split()[:12]))]
    for block in (20_000, 2):
        got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in op2.contaminations(frame(spark, rows), bench, block).collect())
        assert got == collections.Counter((d, i, 0) for d in (1, None, 5, 5, 6) for i in (1, 6)), block
        left = op2.drop_contaminated(frame(spark, rows), bench, block)
        assert left.columns == frame(spark, rows).columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 7, 8]
    assert op2.drop_contaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert op2.contaminations(frame(spark, []), bench).count() == 0
    assert len(list(op2.item_blocks(bench, 2))) == 3


def test_query_and_pipeline_find_items_under_five_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "so it goes"), (2, "one Short, item! here"), (3, "short of item"), (4, None), (5, "so it was")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "short item"), (2, ""), (3, None), (4, "goes"), (5, "so it was not")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op2.op2_cgk_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id, r.distance, r.first_word, r.window_words) for r in got} == {(1, 4, 0, 2, 1), (2, 1, 0, 1, 2)}
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5]


def test_repeated_ids_with_a_third_of_all_rows(spark):
    """One id on a third of the rows: one of its rows stays, whatever group they are in."""
    rnd = random.Random(21)
    hot = prose(rnd, 40)
    rows = [(5, hot)] * 20 + [(5, prose(rnd, 30)) for _ in range(3)] + [(100 + i, prose(rnd, 30)) for i in range(40)]
    got = sorted(r.doc_id for r in op5.keep_one(frame(spark, rows).repartition(4)).collect())
    assert got == [5, *range(100, 140)]


def test_equal_pieces_are_dealt_over_shards(spark):
    """A third of the rows equal in id and text: packed whole, and no shard gets them all."""
    rows = [(None, "")] * 300 + [(i, f"text {i} " * 30) for i in range(600)]
    p = op10.pieces(frame(spark, rows)).withColumn("no", F.monotonically_increasing_id()).checkpoint()
    sizes = [r["count"] for r in op10._pack_round(p, 900, 2048, 100, 0).groupBy("shard").count().collect()]
    assert len(sizes) == 9 and max(sizes) <= 2 * sorted(sizes)[4]
    got = op10.pack(frame(spark, rows), shard_pieces=100).toPandas()
    assert len(got) == 900 and got.groupby("sequence_id")["length"].sum().max() <= 2048


# ------------------------------------------------------------------ pipeline
def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = op8.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    score = model.score(pa.array([t for _, t in rows]))
    rows = brute_lines([r for r, s in zip(rows, score) if s >= 0.3])
    lab = brute_components([brute_fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if lab[k] == k]
    items = [op2.word_hashes(r.text.split()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if len((r.text or "").split()) >= 5]
    clean = []
    for i, t in rows:
        h = op2.word_hashes((t or "").split())
        if not any(op2._edit_ends(a, h, True).min() <= int(0.2 * len(a) + 1e-9) for a in items):
            clean.append((i, t))
    assert 0 < len(clean) < len(rows)
    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert set(got.doc_id) == {i for i, _ in clean}
    want = op10.pieces(spark.createDataFrame(clean, "doc_id long, text string")).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))
    at = got.sort_values(["sequence_id", "offset"])
    assert (at["offset"] == at.groupby("sequence_id")["length"].cumsum() - at["length"]).all()
    assert at.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_handle_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\n" * 50), (3, "a\n" * 50), (None, "null id"), (4, "w" * 30_000), (5, prose(random.Random(1), 50_000))]
    for given in (rows, []):
        docs = frame(spark, given)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= len(given)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= len(given)
    assert corpus_pipeline.ORACLE_SQL is None

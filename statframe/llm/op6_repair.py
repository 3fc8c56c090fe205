"""Token-ID output with Re-Pair grammar compression and random-access decoding.

Texts become ids (end id 0 after each document) in ascending doc_id order, in shards of
about ``SHARD_IDS`` ids of whole documents. A shard is compressed on its own: in each round
all neighbouring pairs are counted, the ``ROUND_RULES`` most frequent ones become
nonterminals, and their occurrences are replaced, the more frequent pair first where
two overlap; rounds follow until no pair occurs ``MIN_COUNT`` times (fewer would not pay for
the rule) or the 16-bit symbol space is full. The end id is in no rule, so no rule crosses a document.

File format: Parquet, a row per shard, sorted by (part, shard).

=========  =============  ====================================================================
column     type           content
=========  =============  ====================================================================
part       int            range of doc_id the shard belongs to; parts ascend with doc_id
shard      int            number of the shard in its part
before     long           ids of the part before this shard
n_ids      long           ids of the shard
doc_ids    array          its documents, ascending
symbol_at  array<int>     first symbol of each document in ``symbols``
symbols    binary         little-endian uint16: ids, and ``FIRST_RULE`` + i for rule i
rules      binary         little-endian uint16 pairs: left and right symbol of rule i
lengths    binary         little-endian uint32: ids that rule i expands to
=========  =============  ====================================================================

``lengths`` gives the id offset of every symbol without expanding it, so a document, or a
range of its ids, is decoded from its own symbols alone (``document_ids``, ``id_range``).

Defined results: null text counts as empty (the end id alone); equal doc_ids stand next to
each other, ordered by text hash; null doc_ids come first; a document longer than a shard
is a shard of its own; an empty table gives a file without rows; only ``doc_id`` and ``text`` are read, so
further columns cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import table
from .tokens import END_ID, encoded_slices, task_done, vocabulary_path

SHARD_IDS = 1 << 20
#: Nonterminals start above the vocabulary's 50,257 ids and end with 16 bits.
FIRST_RULE, MAX_RULES = 50_257, 65_536 - 50_257
#: Pairs replaced in a round, and the least occurrences: a rule takes 8 bytes, a replaced pair saves 2.
ROUND_RULES, MIN_COUNT = 1024, 5

def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, and the number of each key among them)."""
    enc = pa.array(keys).dictionary_encode()
    return enc.dictionary.to_numpy(), enc.indices.to_numpy().astype(np.intp)


def _top(keys: np.ndarray, count: np.ndarray, room: int, min_count: int) -> np.ndarray:
    """Where the (up to ``room``) keys of largest count stand, ``min_count`` at least, falling; of equal counts the smaller key first."""
    often = np.flatnonzero(count >= min_count)
    if len(often) > room:
        c = count[often]
        often = often[c >= np.partition(c, len(c) - room)[len(c) - room]]
    return often[np.lexsort((keys[often], -count[often]))][:room]


def _frequent(keys: np.ndarray, room: int, min_count: int) -> np.ndarray:
    """The (up to ``room``) most frequent keys with ``min_count`` or more occurrences, falling."""
    pairs, count = np.unique(keys, return_counts=True)
    return pairs[_top(pairs, count, room, min_count)]


def _keys(s: np.ndarray, at: np.ndarray | slice, after: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left << 16 | right) at some places, and which of them may become a rule."""
    left, right = s[at], s[after]
    return left.astype(np.uint32) << np.uint32(16) | right, (left != END_ID) & (right != END_ID)


def _often(key: np.ndarray, inner: np.ndarray, min_count: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that occur ``min_count`` times among ``key`` where ``inner``, their counts, the number of the pair at each
    place): numbers from ``first`` on, and 0 for the other places."""
    keys, number = _numbered(key[inner])
    count = np.bincount(number, minlength=len(keys))
    often = count >= min_count
    number_of = np.where(often, first - 1 + np.cumsum(often), 0)
    out = np.zeros(len(key), np.intp)
    out[inner] = number_of[number]
    return keys[often], count[often], out


def _apart(at: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (ascending, with ranks ``r``) are replaced if the lowest rank goes first, from left to right
    within a rank, and a place goes only if none beside it went. A place waits for the neighbours that come before it, so
    in a chain of rising ranks every second one goes, counted from the lowest, as in a falling chain from its end."""
    i = np.arange(len(at))
    near = at[1:] == at[:-1] + 1
    left = near & (r[:-1] <= r[1:])  # the left one of two neighbours comes first
    rising = i - np.maximum.accumulate(np.where(np.r_[False, left], 0, i))
    falling = np.minimum.accumulate(np.where(np.r_[near & ~left, False], len(at), i)[::-1])[::-1] - i
    return (rising | falling) & 1 == 0


def _beside(at: np.ndarray, n: int, after: int) -> np.ndarray:
    """The places ``at`` (ascending, no two neighbours if ``after``), those before them and the ``after`` places behind them, below ``n``, each once."""
    near = (at[:, None] + np.arange(-1, after + 1)).ravel()
    return near[np.r_[True, near[1:] != near[:-1]] & (near >= 0) & (near < n)]


def compress(ids: np.ndarray, round_rules: int = ROUND_RULES, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a shard: uint16 symbols and an (n, 2) array of rule pairs. Rounds go on until no
    pair occurs ``min_count`` times or the symbols are used up.

    Every place holds the number of its pair, every number its count; a round looks up and counts anew only the pairs
    beside replaced places. A pair replaced in a round is gone after it (``_apart``), and new places of a pair come only in the
    round that makes the later one of its symbols. So a pair has one rule, and one that is rare then stays rare and needs no number."""
    s = ids.astype(np.uint16)
    rules = np.zeros(0, np.uint32)  # left << 16 | right
    keys, count, pair = _often(*_keys(s, slice(0, -1), slice(1, None)), min_count, 1)
    keys, count = np.r_[np.uint32(0), keys], np.r_[0, count]  # number 0: no rule, rare or with the end id
    while len(s) > 1 and len(rules) < MAX_RULES:
        top = _top(keys, count, min(round_rules, MAX_RULES - len(rules)), min_count)
        n = len(top)
        if not n:
            break
        rank_of = np.full(len(keys), n, np.int32)
        rank_of[top] = np.arange(n)
        at = np.flatnonzero((rank_of < n).take(pair))
        r = rank_of[pair[at]]
        take = _apart(at, r)
        at, r = at[take], r[take]
        made = np.bincount(r, minlength=n) > 0
        s[at] = (FIRST_RULE + len(rules) - 1 + np.cumsum(made))[r].astype(np.uint16)
        rules = np.r_[rules, keys[top[made]]]
        count -= np.bincount(pair[_beside(at, len(pair), 1)], minlength=len(keys))
        count[0] = 0
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        pair = pair[keep[:-1]][:len(s) - 1]
        # the pairs that a new symbol begins or ends
        at = _beside(at - np.arange(len(at)), len(pair), 0)
        new, new_count, pair[at] = _often(*_keys(s, at, at + 1), min_count, len(keys))
        keys, count = np.r_[keys, new], np.r_[count, new_count]
    return s, np.stack([rules >> np.uint32(16), rules & np.uint32(0xFFFF)], axis=1).astype(np.uint16)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids each rule expands to (a rule uses ids and earlier rules only)."""
    out = np.zeros(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    side = rules.astype(np.int64) - FIRST_RULE
    while todo.any():
        ready = todo & ~((side >= 0) & todo[np.maximum(side, 0)]).any(axis=1)
        part = np.where(side[ready] >= 0, out[np.maximum(side[ready], 0)], 1)
        out[ready] = part.sum(axis=1)
        todo &= ~ready
    return out


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols."""
    s = symbols.astype(np.uint32)
    while True:
        rule = s >= FIRST_RULE
        if not rule.any():
            return s
        at = np.flatnonzero(rule)
        pair = rules[s[at] - FIRST_RULE]
        out = np.repeat(s, 1 + rule)
        first = at + np.arange(len(at))
        out[first], out[first + 1] = pair[:, 0], pair[:, 1]
        s = out


class Expander:
    """Ids of symbol runs of one shard by lookup: every rule expanded once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        rule_ids = expand(np.arange(FIRST_RULE, FIRST_RULE + len(rules), dtype=np.uint32), rules)
        self.flat = np.r_[np.arange(FIRST_RULE, dtype=np.uint32), rule_ids]
        self.size = np.r_[np.ones(FIRST_RULE, np.int64), lengths.astype(np.int64)]
        self.at = np.cumsum(self.size) - self.size

    def __call__(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each symbol's ids)."""
        size = self.size[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[symbols] - (ends - size), size) + np.arange(total)], ends


def read_shard(row: dict) -> dict:
    """The arrays of one shard row."""
    return {"symbols": np.frombuffer(row["symbols"], "<u2"), "rules": np.frombuffer(row["rules"], "<u2").reshape(-1, 2),
            "lengths": np.frombuffer(row["lengths"], "<u4"), "at": np.r_[np.asarray(row["symbol_at"], np.int64), len(row["symbols"]) // 2]}


def document_ids(shard: dict, k: int) -> np.ndarray:
    """All ids of the shard's k-th document."""
    return expand(shard["symbols"][shard["at"][k]:shard["at"][k + 1]], shard["rules"])


def id_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the shard, from the symbols that cover them."""
    s = shard["symbols"]
    size = np.where(s >= FIRST_RULE, shard["lengths"][np.maximum(s.astype(np.int64) - FIRST_RULE, 0)] if len(shard["lengths"]) else 1, 1)
    ends = np.cumsum(size)
    lo, hi = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    skip = start - (int(ends[lo - 1]) if lo else 0)
    return expand(s[lo:hi], shard["rules"])[skip:skip + stop - start]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order to ``path``."""
    vocab = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shards(batches):
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names, ids, sizes, held = [], [], [], 0

        def close():
            nonlocal shard, before, names, ids, sizes, held
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            symbols, rules = compress(flat)
            # a document starts after its predecessor's end: count the symbols' ids up to it
            length = rule_lengths(rules)
            width = np.r_[np.ones(FIRST_RULE, np.int64), length][symbols]
            at = np.searchsorted(np.cumsum(width) - width, np.cumsum(size) - size)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(names)),
                pa.array([at], pa.list_(pa.int32())), pa.array([symbols.astype("<u2").tobytes()]), pa.array([rules.astype("<u2").tobytes()]),
                pa.array([length.astype("<u4").tobytes()])],
                names=["part", "shard", "before", "n_ids", "doc_ids", "symbol_at", "symbols", "rules", "lengths"])
            shard, before = shard + 1, before + len(flat)
            names, ids, sizes, held = [], [], [], 0
            return row

        for batch in batches:
            for lo, count, got in encoded_slices(batch.column(1), vocab):
                done = 0
                while done < len(count):
                    room = np.searchsorted(np.cumsum(count[done:]) + held, shard_ids, side="left") + 1
                    n = int(min(room, len(count) - done))
                    a, b = int(count[:done].sum()), int(count[:done + n].sum())
                    names.append(batch.column(0).slice(lo + done, n))
                    ids.append(got[a:b])
                    sizes.append(count[done:done + n])
                    held += b - a
                    done += n
                    if held >= shard_ids:
                        yield close()
        if held:
            yield close()
        task_done(vocab)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row number parts rows that are equal in id and text
    d = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
         .withColumns({"th": F.xxhash64("text"), "no": F.monotonically_increasing_id()}))
    (d.repartitionByRange(n, "doc_id", "th", "no").sortWithinPartitions("doc_id", "th", "no").select("doc_id", "text").mapInArrow(
        shards, f"part int, shard int, before long, n_ids long, doc_ids array<{kind}>, symbol_at array<int>, "
                "symbols binary, rules binary, lengths binary").write.parquet(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    offset, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row per range of doc_id
        offset[r["part"]] = total
        total += r["n"]

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sh = read_shard({c: row[c].as_py() for c in ("symbols", "rules", "lengths", "symbol_at")})
                names = row["doc_ids"].values
                flat, ends = Expander(sh["rules"], sh["lengths"])(sh["symbols"])
                cut = np.r_[0, ends][sh["at"]]  # where each document's ids begin, and the end
                size = np.diff(cut)
                flat = flat.astype("<u4", copy=False)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
                start = offset[row["part"].as_py()] + row["before"].as_py() + np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([names, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "doc_ids", "symbol_at", "symbols", "rules", "lengths").mapInArrow(
        decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op6-ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_ids(spark, path)

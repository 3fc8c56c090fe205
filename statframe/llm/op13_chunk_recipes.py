"""Exact dedup by content-defined chunk recipes.

1. Every whole text is cut where a rolling hash of its last ``WINDOW`` bytes ends in zero bits
   (chunks of ``MIN_CHUNK`` to ``MAX_CHUNK`` bytes, about ``MEAN_CHUNK``), so equal texts, and equal
   passages of different texts, give equal chunks. A text becomes its *recipe*: the ordered
   list of its chunks' 128-bit hashes, with its length.
2. Chunks are deduplicated: one partial aggregate by hash keeps the least and the greatest
   content. Where they agree, all contents under the hash have been compared and the hash is a
   *verified identifier*. Where they differ (a hash collision), the distinct contents are
   numbered and the chunks of such hashes get hash and number as identifier.
3. Rows are grouped by their lists of verified identifiers. Lists are equal exactly where the
   texts are.

Texts cross the network once, as distinct chunks of a task; afterwards only recipes (16
bytes per chunk) move. The recipe table is written in the shared folder, so row numbers and
lists stand still when executors are lost. Groups are counted by partial aggregation. A group with more than
1 / ``HEAVY_GROUPS`` of all rows and a short recipe is joined back by a broadcast of fewer than
``HEAVY_GROUPS`` rows, the others by a shuffle in which no such key is left.

Defined results: null text counts as empty, all empty texts are one group; of equal texts the row
with the largest doc_id stays, of rows equal in id too the one read last; a null id is smaller
than any other, and a group of null ids only has a null ``keep_id``; an empty table gives no row; a text of
any length is cut over its whole length. Only ``doc_id`` and ``text`` are read;
:func:`drop_copies` carries further columns along under any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import free_name, table, text_slices

WINDOW = 16
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
ID_BYTES = 16
#: Bytes hashed in one vectorised step.
BLOCK = 1 << 20
HEAVY_GROUPS, SHORT_RECIPE = 1000, 4096


def _gear() -> np.ndarray:
    """A 64-bit number per byte value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)


GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each byte, doubled up from single bytes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def marked_ends(data: np.ndarray, mean: int) -> np.ndarray:
    """Places behind the bytes whose hash begins with zero bits, block by block."""
    out, zeros = [], np.uint64(64 - (mean.bit_length() - 1))
    for lo in range(0, len(data), BLOCK):
        skip = min(lo, WINDOW)
        h = rolling_hash(data[lo - skip:lo + BLOCK])[skip:]
        out.append(np.flatnonzero(h >> zeros == 0) + lo + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(marks: np.ndarray, n: int, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a text of ``n`` bytes; ``marks`` are its marked ends, ascending."""
    out, at = [], 0
    marks = marks.tolist()
    i = 0
    while n - at > least:
        while i < len(marks) and marks[i] < at + least:
            i += 1
        end = marks[i] if i < len(marks) and marks[i] <= at + most else at + most
        if end >= n:
            break
        out.append(end)
        at = end
    if n:
        out.append(n)
    return out


def chunks_of(texts: pa.Array, mean: int = MEAN_CHUNK) -> list[tuple[memoryview, list[int]]]:
    """(bytes, chunk ends) of each text of a slice."""
    big = texts.cast(pa.large_binary())
    at = np.frombuffer(big.buffers()[1], np.int64, len(big) + 1, big.offset * 8)
    body = big.buffers()[2]
    raw = memoryview(body)[int(at[0]):int(at[-1])] if body is not None else memoryview(b"")
    at = at - at[0]
    marks = marked_ends(np.frombuffer(raw, np.uint8), mean)
    lo = np.searchsorted(marks, at[:-1] + MIN_CHUNK)
    hi = np.searchsorted(marks, at[1:], side="right")
    return [(raw[a:b], chunk_ends(marks[i:j] - a, b - a)) for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), lo.tolist(), hi.tolist())]


def _name(chunk, bits: int) -> bytes:
    """The chunk's hash; fewer than 128 ``bits`` only to test collisions."""
    x = xxhash.xxh3_128_intdigest(chunk)
    return (x >> (128 - bits)).to_bytes(ID_BYTES, "big")


def _walk(texts: pa.Array):
    """(row, bytes, chunk ends) of every text; null counts as empty."""
    texts = pc.fill_null(texts, b"")
    for lo, part in text_slices(texts):
        for r, (raw, ends) in enumerate(chunks_of(part)):
            yield lo + r, raw, ends


def recipes(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, row, recipe, text_sha256) of every row, as a written table. ``recipe`` is the length in
    bytes and the hashes of the chunks, in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            recipe, sha = [], []
            for _, raw, ends in _walk(batch.column(1)):
                names = [_name(raw[a:b], bits) for a, b in zip([0, *ends], ends)]
                recipe.append(len(raw).to_bytes(8, "big") + b"".join(names))
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())],
                                             names=["doc_id", "recipe", "text_sha256"])

    out = _bytes(docs).mapInArrow(cut, f"doc_id {kind}, recipe binary, text_sha256 string")
    return _kept(out.withColumn("row", F.monotonically_increasing_id()), "op13-recipes")


def chunk_contents(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(name, content) of every chunk of every text."""
    def cut(batches):
        for batch in batches:
            names, contents, size = [], [], 0
            for _, raw, ends in _walk(batch.column(1)):
                for a, b in zip([0, *ends], ends):
                    names.append(_name(raw[a:b], bits))
                    contents.append(bytes(raw[a:b]))
                    size += b - a
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary())], names=["name", "content"])
                    names, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary())], names=["name", "content"])

    return _bytes(docs).mapInArrow(cut, "name binary, content binary")


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def clashing_chunks(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(name, content, number) of the distinct contents of every name that has several."""
    content = chunk_contents(docs, bits)
    several = _kept(content.groupBy("name").agg(F.min("content").alias("a"), F.max("content").alias("b"))
                    .where(F.col("a") != F.col("b")).select("name"), "op13-clashes")
    if several.isEmpty():
        return docs.sparkSession.createDataFrame([], "name binary, content binary, number int")
    distinct = content.join(several, "name", "left_semi").distinct()
    return _kept(distinct.withColumn("number", F.row_number().over(Window.partitionBy("name").orderBy("content"))), "op13-numbers")


def verified_recipes(docs: DataFrame, bits: int = 128) -> DataFrame:
    """:func:`recipes` whose lists hold verified identifiers: rows have equal recipes exactly where
    their texts are equal."""
    rows = recipes(docs, bits)
    clash = clashing_chunks(docs, bits)
    if clash.isEmpty():
        return rows
    # rows with a chunk of such a name: their lists get the numbers of the contents as well
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            ids, sha, pos, names, contents = [], [], [], [], []
            for r, raw, ends in _walk(batch.column(1)):
                digest = hashlib.sha256(raw).hexdigest()
                for k, (a, b) in enumerate(zip([0, *ends], ends)):
                    ids.append(r)
                    sha.append(digest)
                    pos.append(k)
                    names.append(_name(raw[a:b], bits))
                    contents.append(bytes(raw[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sha, pa.string()), pa.array(pos, pa.int32()),
                                              pa.array(names, pa.binary()), pa.array(contents, pa.binary())],
                                             names=["doc_id", "sha", "pos", "name", "content"])

    numbered = (_bytes(docs).mapInArrow(spread, f"doc_id {kind}, sha string, pos int, name binary, content binary")
                .join(clash, ["name", "content"]).groupBy(F.col("doc_id").alias("i"), F.col("sha").alias("s"))
                .agg(F.array_sort(F.collect_set(F.struct("pos", "number"))).alias("numbers")))
    same = rows["doc_id"].eqNullSafe(numbered["i"]) & (rows["text_sha256"] == numbered["s"])
    longer = F.when(F.col("numbers").isNull(), F.col("recipe")).otherwise(F.concat("recipe", F.to_json("numbers").cast("binary")))
    return rows.join(numbered, same, "left").withColumn("recipe", longer).select(rows.columns)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def copy_groups(docs: DataFrame, bits: int = 128, heavy_groups: int = HEAVY_GROUPS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row) of every row of ``docs``."""
    rows = verified_recipes(docs, bits)
    top = F.max(F.struct("doc_id", "row"))
    groups = _kept(rows.groupBy("recipe").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1), "op13-groups")
    # fewer than heavy_groups groups can hold more than this share of the rows
    many = rows.count() // heavy_groups
    heavy = (F.col("group_size") > F.lit(many)) & (F.length("recipe") <= SHORT_RECIPE)
    first = rows.join(F.broadcast(groups.where(heavy)), "recipe", "left")
    cols = ["doc_id", "row", "text_sha256", "top", "group_size"]
    rest = first.where(F.col("group_size").isNull()).drop("top", "group_size").join(groups.where(~heavy), "recipe", "left")
    out = first.where(F.col("group_size").isNotNull()).select(cols).unionByName(rest.select(cols))
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (alone | (F.col("row") == F.col("top.row"))).alias("kept"), "text_sha256", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts stays."""
    numbered = _kept(docs.withColumn(free_name(docs, "_no"), F.monotonically_increasing_id()), "op13-rows")
    no = numbered.columns[-1]
    keyed = numbered.select(F.struct("doc_id", F.col(no).alias("no")).alias("doc_id"), "text")
    gone = copy_groups(keyed).where(~F.col("kept")).select(F.col("doc_id.no").alias(no))
    return numbered.join(gone, no, "left_anti").drop(no)


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents")).drop("row")


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

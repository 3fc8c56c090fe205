"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over immutable buffers: its own
UTF-8 text and the sentinels. *Cutting* splits the one descriptor of the text at two byte
offsets; an *arrangement* is a permutation of sentinels and parts. Restoring reads an output
alone: its sentinels cut the output's descriptor, the inverse permutation puts the parts
back and the sentinels are left out. Hashes run over the descriptors, so no arrangement is
copied for them; texts are put together only where they are asked for.

Cuts and form are drawn from sha256 of ``<seed>:<doc_id>`` (see :func:`draws`), so a rerun after a
lost executor gives the same. Every document is handled in place by one map over Arrow
batches, without a shuffle; memory is one batch and one output text.

Defined results: null text counts as empty, and an empty text is plain; a text that holds a
sentinel is plain, so restoring is exact; null ids draw as an empty string; rows with
equal id and text get the same; an empty table gives no row; texts of any length are
cut over their whole length. Of the input only ``doc_id`` and ``text`` are read; :func:`fill_in_middle`
carries further columns along and names its own so that they do not clash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Arrangement of each form: places 0-2 are the sentinels, 3-5 prefix, middle and suffix.
ARRANGEMENTS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}
FIELDS = "n long, form string, prefix_chars long, middle_chars long"


class Piece(NamedTuple):
    buffer: memoryview
    start: int
    length: int

    def view(self) -> memoryview:
        return self.buffer[self.start:self.start + self.length]


def cut(piece: Piece, *ends: int) -> list[Piece]:
    """Split a descriptor at offsets counted from its start."""
    at = [0, *ends, piece.length]
    return [Piece(piece.buffer, piece.start + a, b - a) for a, b in zip(at, at[1:])]


def digest(pieces: list[Piece]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.view())
    return h.hexdigest()


def joined(pieces: list[Piece]) -> bytes:
    return b"".join(p.view() for p in pieces)


class CodePoints:
    """Code points of a UTF-8 text and the byte offsets they start at."""

    def __init__(self, text: bytes):
        self.size = len(text)
        self.starts = None
        self.n = self.size
        if not text.isascii():
            self.starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            self.n = len(self.starts)

    def offset(self, k: int) -> int:
        return k if self.starts is None else self.size if k >= self.n else int(self.starts[k])


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four numbers of a document: the first 8-digit groups of sha256 of ``<seed>:<doc_id>``."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[i:i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: bytes, doc_id, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
            sentinels: tuple = SENTINELS) -> tuple[list[Piece], int, str, int | None, int | None]:
    """(pieces, code points, form, prefix_chars, middle_chars) of a document."""
    points = CodePoints(text)
    whole = Piece(memoryview(text), 0, len(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= plain_from or any(s in text for s in sentinels):
        return [whole], points.n, "plain", None, None
    a, b = sorted((h1 % (points.n + 1), h2 % (points.n + 1)))
    form = "spm" if h4 % 100 < spm_below else "psm"
    slots = [Piece(memoryview(s), 0, len(s)) for s in sentinels] + cut(whole, points.offset(a), points.offset(b))
    return [slots[i] for i in ARRANGEMENTS[form]], points.n, form, a, b - a


def restore(output: bytes, form: str, sentinels: tuple = SENTINELS) -> list[Piece]:
    """Descriptors over ``output`` that spell the document again."""
    whole = Piece(memoryview(output), 0, len(output))
    if form == "plain":
        return [whole]
    order, ends, at = ARRANGEMENTS[form], [], 0
    for slot in order:
        if slot < 3:  # a part holds no sentinel, so the next one found is this one
            at = output.index(sentinels[slot], at)
            ends += [at, at + len(sentinels[slot])]
            at = ends[-1]
    parts = cut(whole, *ends)[1:]  # what stands before the first sentinel is empty
    inverse = np.argsort(order)
    return [parts[inverse[slot]] for slot in (3, 4, 5)]


def _forms(batches, options: dict, with_text: bool, with_hash: bool):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = []
        for doc_id, value in zip(ids, batch.column(1)):
            text = value.as_py() or b""
            pieces, n, form, prefix, middle = arrange(text, doc_id, **options)
            row = [n, form, prefix, middle]
            if with_text:
                row.append(joined(pieces))
            if with_hash:
                out = joined(pieces) if form != "plain" else text
                row += [digest(pieces), digest(restore(out, form, options.get("sentinels", SENTINELS)))]
            rows.append(row)
        cols = list(zip(*rows)) if rows else [()] * (4 + with_text + 2 * with_hash)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_text + [pa.string()] * (2 * with_hash)
        names = ["n", "form", "prefix_chars", "middle_chars"] + ["output"] * with_text + ["output_sha256", "restored_sha256"] * with_hash
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        if with_text:
            arrays[4] = arrays[4].cast(pa.string())
        yield pa.StructArray.from_arrays(arrays, names=names)


def _column(options: dict, with_text: bool, with_hash: bool):
    kind = "struct<" + FIELDS.replace(" long", ":long").replace(" string", ":string")
    kind += ", output:string" * with_text + ", output_sha256:string, restored_sha256:string" * with_hash + ">"

    @F.arrow_udf(kind)
    def forms(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return next(_forms([pa.RecordBatch.from_arrays([ids, texts], names=["i", "t"])], options, with_text, with_hash))

    return forms(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary"))


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``output`` (the arranged text), ``form``, ``n``, ``prefix_chars`` and
    ``middle_chars``; where ``docs`` has such a column, the new one gets trailing underscores."""
    new = free_name(docs, "_fim")
    out = docs.withColumn(new, _column(options, True, False))
    for c in ("output", "form", "n", "prefix_chars", "middle_chars"):
        out = out.withColumn(free_name(out, c), F.col(f"{new}.{c}"))
    return out.drop(new)


def restored_text(output: str, form: str, sentinels: tuple = SENTINELS):
    """Column of the exact text rebuilt from the columns ``output`` and ``form``."""
    @F.arrow_udf("string")
    def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts = [None if o is None else joined(restore(o, f, sentinels)) for o, f in zip(outputs.to_pylist(), forms.to_pylist())]
        return pa.array(texts, pa.binary()).cast(pa.string())

    return rebuilt(F.col(output).cast("binary"), F.col(form))


def fim_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return docs.select("doc_id", _column(options, False, True).alias("f")).select("doc_id", "f.*")


def op12_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
d AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
             CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
             substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, prefix_chars, middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM o
"""

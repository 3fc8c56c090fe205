"""Token ids of whole texts by a public byte-level BPE, each distinct piece encoded once.

The vocabulary's pre-tokenizer never joins characters across the cuts made here (before a
space, around a line feed, and between a letter or digit and closing punctuation), so the ids of
a text are those of its pieces, one after the other. Texts with white space for which that
does not hold (runs of three, a run at the end, tabs, other Unicode spaces, control marks),
and texts that contain the string of an added or special token, are encoded whole. Ids are those of a
plain ``encode(text, add_special_tokens=False)``: such a string becomes its token's id.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Distinct pieces kept during a task (about 40 bytes each) and after it, and the longest piece kept.
MAX_PIECES, REST_PIECES, MAX_PIECE = 1_000_000, 300_000, 64
#: Text bytes of one slice, for which the kept pieces are hashed once; pieces whose ids are put together, and new pieces encoded, at a time.
SLICE_BYTES, BLOCK_PIECES, NEW_PIECES = 8_000_000, 250_000, 20_000
WHOLE = (r"\s\s\s|\s\s$|[\x00\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: Pieces whose pre-tokens are for certain their runs of letters, digits and marks (no apostrophe), a space before them going with the first.
RUNS = r"\A ?[!-&(-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
CLOSING = b".,;:!?"


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others in their order
    for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(other)) for b in range(256)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, where each text begins in them and where the last one ends) of strings without nulls."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def _letters_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character of two bytes or more that ends before each place is a letter or a number."""
    back = np.stack([data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4)]).astype(np.int64)
    size = 2 + (back[1] < 0xC0) + ((back[1] < 0xC0) & (back[2] < 0xC0))
    code = sum(np.where(k < size, (back[k - 1] & 0x3F) << 6 * (k - 1), 0) for k in (1, 2, 3))
    lead = back[size - 1, np.arange(len(at))]
    code += (lead & (0x7F >> size)) << 6 * (size - 1)
    chars, of = np.unique(code, return_inverse=True)
    return pc.match_substring_regex(pa.array(map(chr, chars.tolist()), pa.string()), r"\A[\pL\pN]\z").to_numpy(zero_copy_only=False)[of]


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, which begin at ``starts``."""
    line = data == 10
    cut = (data == 32) | line
    cut[1:] |= line[:-1]
    closing = np.flatnonzero(reduce(np.logical_or, [data[1:] == c for c in CLOSING])) + 1
    before = data[closing - 1]
    letter = ((before >= 48) & (before < 58)) | (((before | 32) >= 97) & ((before | 32) < 123))
    wide = np.flatnonzero(before >= 0x80)
    letter[wide] = False
    if len(wide):
        letter[wide] = _letters_before(data, closing[wide])
    cut[closing[letter]] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class PieceTokenizer:
    """Ids of texts with an end id after each; the memo lives as long as the worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # texts with the string of an added token go whole: the tokenizer finds it before it cuts
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([WHOLE, *added])
        # the same merge model for pre-tokens in the byte alphabet, which has no white space, a line each
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, alphabet = self.tokenizer.get_vocab(with_added_tokens=False), byte_alphabet()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.all_bytes = all(c in vocab for c in alphabet.values())
        coded = [alphabet[b].encode() for b in range(256)]
        self.char_size = np.array(list(map(len, coded)), np.int64)
        self.char = np.array([[x[0], x[-1]] for x in coded], np.uint8)
        kind = np.full(256, 2, np.uint8)  # letters 0, digits 1, marks 2, a space 3
        kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
        kind[48:58], kind[32] = 1, 3
        self.kind = kind
        self._clear()

    def _clear(self):
        self.code = pa.array(["", "\x01"], pa.string())  # a piece's place is its code
        self.size = np.zeros(1 << 16, np.int64)
        self.at = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.size[1] = 1
        self.flat[0] = END_ID
        self.n, self.used = 2, 1

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each piece, all ids) of pieces that match ``RUNS``: their runs go straight to the merge model."""
        data, starts = text_bytes(pieces)
        first = starts[:-1]
        kind = self.kind[data]
        new_run = np.r_[True, (kind[1:] != kind[:-1]) & (kind[:-1] != 3)]
        new_run[first] = True
        wide = self.char_size[data]
        at = np.cumsum(wide + new_run) - wide
        out = np.full(int(at[-1] + wide[-1]), 10, np.uint8)
        out[at] = self.char[data, 0]
        two = np.flatnonzero(wide == 2)
        out[at[two] + 1] = self.char[data[two], 1]
        got = self.merges.encode_batch_fast([out.tobytes().decode()], add_special_tokens=False)[0]
        ids = np.array(got.ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), starts[1:]) + 1
        return np.diff(np.r_[0, ends]), ids

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of each piece, where they begin, all ids)."""
        runs = pc.match_substring_regex(pieces, RUNS).to_numpy(zero_copy_only=False) & self.all_bytes
        sure = pieces.filter(pa.array(runs))
        got = [self._run_ids(sure.slice(lo, NEW_PIECES)) for lo in range(0, len(sure), NEW_PIECES)]
        rest = self.ids(pieces.filter(pa.array(~runs)).to_pylist())
        sizes = [np.zeros(0, np.int64), *(x[0] for x in got), np.fromiter(map(len, rest), np.int64, len(rest))]
        flat = [np.zeros(0, np.uint32), *(x[1] for x in got), np.fromiter(chain.from_iterable(rest), np.uint32)]
        order = np.r_[np.flatnonzero(runs), np.flatnonzero(~runs)]
        size, at = np.empty((2, len(pieces)), np.int64)
        size[order] = np.concatenate(sizes)
        at[order] = np.cumsum(size[order]) - size[order]
        return size, at, np.concatenate(flat)

    def _add(self, pieces: pa.Array) -> None:
        size, at, ids = self._piece_ids(pieces)
        n, used = self.n + len(size), self.used + len(ids)
        while n > len(self.size):
            self.size, self.at, self.uses = (np.r_[x, np.zeros_like(x)] for x in (self.size, self.at, self.uses))
        while used > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used:used] = ids
        self.size[self.n:n], self.at[self.n:n], self.uses[self.n:n] = size, self.used + at, 0
        self.n, self.used = n, used

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Code of each piece; new pieces are encoded, long ones for this call only (see ``_drop``)."""
        if self.n > MAX_PIECES:
            self._clear()
        found = pc.index_in(pieces, value_set=self.code)
        codes = pc.fill_null(found, 0).to_numpy().astype(np.intp)
        miss = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        self.kept = (self.n, self.used)
        if len(miss):
            enc = pieces.take(pa.array(miss)).dictionary_encode()
            new = enc.dictionary
            long = pc.greater(pc.utf8_length(new), MAX_PIECE).to_numpy(zero_copy_only=False)
            code_of = np.empty(len(new), np.intp)
            code_of[~long] = self.n + np.arange(len(new) - int(long.sum()))
            short = new.filter(pa.array(~long))
            self._add(short)
            self.code = pa.concat_arrays([self.code, short])
            self.kept = (self.n, self.used)
            if long.any():
                code_of[long] = self.n + np.arange(int(long.sum()))
                self._add(new.filter(pa.array(long)))
            codes[miss] = code_of[enc.indices.to_numpy()]
        return codes

    def _drop(self):
        self.n, self.used = self.kept

    def rest(self, keep: int = REST_PIECES) -> None:
        """Keep only the most used pieces: between tasks a worker serves other operators too."""
        if self.n <= keep + 2:
            return
        code, size, at, flat, uses = self.code, self.size, self.at, self.flat, self.uses[:self.n]
        top = np.r_[0, 1, np.sort(np.argpartition(-uses[2:], keep)[:keep] + 2)]
        self.code = code.take(pa.array(top))
        self.size, self.uses = size[top], uses[top]
        ends = np.cumsum(self.size)
        self.at = ends - self.size
        self.flat = flat[np.repeat(at[top] - self.at, self.size) + np.arange(int(ends[-1]))]
        self.n, self.used = len(top), int(ends[-1])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = text_bytes(texts)
        first = cuts(data, starts[:-1][starts[:-1] < starts[1:]]) if len(data) else np.zeros(0, np.int64)
        ends = pa.py_buffer(np.r_[first, len(data)].astype(np.int32))
        codes = self._codes(pa.StringArray.from_buffers(len(first), ends, pa.py_buffer(data)))
        self.uses[:self.n] += np.bincount(codes, minlength=self.n)
        # an end id after the pieces of each text
        pieces = np.searchsorted(first, starts)
        of = np.ones(len(codes) + len(texts), np.intp)
        of[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(pieces))] = codes
        size = self.size[of]
        ends = np.cumsum(size)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for lo in range(0, len(of), BLOCK_PIECES):
            part, n, end = of[lo:lo + BLOCK_PIECES], size[lo:lo + BLOCK_PIECES], ends[lo:lo + BLOCK_PIECES]
            a, b = int(end[0] - n[0]), int(end[-1])
            ids[a:b] = self.flat[np.repeat(self.at[part] - (end - n), n) + np.arange(a, b)]
        self._drop()
        return np.diff(np.r_[0, ends[pieces[1:] + np.arange(len(texts))]]), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids): every text's ids and then the end id; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._pieces(texts)
        part = self._pieces(texts.filter(pa.array(~whole)))
        count = np.empty(len(texts), np.int64)
        count[~whole] = part[0]
        odd = [np.array([*x, END_ID], np.uint32) for x in self.ids(texts.filter(pa.array(whole)).to_pylist())]
        count[whole] = [len(x) for x in odd]
        easy = iter(np.split(part[1], np.cumsum(part[0])[:-1]) if len(part[0]) else [])
        hard = iter(odd)
        return count, np.concatenate([next(hard) if w else next(easy) for w in whole])


_LOADED: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


def encoded_slices(texts: pa.Array, path: str):
    """(first row, ids per text, ids) for slices of bounded size."""
    t = tokenizer(path)
    for lo, part in text_slices(texts, SLICE_BYTES):
        yield lo, *t.encode(part)


def task_done(path: str) -> None:
    """Called when a task has read its last batch."""
    tokenizer(path).rest()

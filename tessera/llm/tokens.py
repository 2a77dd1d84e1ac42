"""Token ids of texts, as bytes, with a bounded memory of what a Python worker has already encoded."""

from __future__ import annotations

import json
import re
import sys
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values: the white space of the byte-level pattern (Unicode White_Space)
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# white space that isn't a lone blank or newline, or the mark that chunks are cut by
_BLANK = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ODD = f"[{_BLANK}][{_BLANK}]|[^\\n \\PZ]|[\\t\\x0b-\\r\\x{{85}}\\x{{0}}]"
# letters that every version of Unicode since 5.0 has, so Arrow's tables and the library's agree on them
_LETTERS = ("A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{241}\\x{250}-\\x{2af}\\x{388}-\\x{38a}\\x{38e}-\\x{3a1}"
            "\\x{3a3}-\\x{3ce}\\x{400}-\\x{481}\\x{48a}-\\x{513}\\x{531}-\\x{556}\\x{561}-\\x{587}\\x{5d0}-\\x{5ea}\\x{621}-\\x{63a}\\x{641}-\\x{64a}"
            "\\x{905}-\\x{939}\\x{e01}-\\x{e30}\\x{10d0}-\\x{10f0}\\x{1e00}-\\x{1e9b}\\x{1ea0}-\\x{1ef9}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}"
            "\\x{3400}-\\x{4db5}\\x{4e00}-\\x{9fa5}\\x{ac00}-\\x{d7a3}")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = f"^ ?(?:[{_LETTERS}]+|[0-9]+)$"
_WHOLE = f"^ ?(?:[{_LETTERS}]+|[0-9]+|[!-/:-@\\[-`{{-~]+)$"  # what the byte-level pattern takes as one
CACHE_BYTES = 64 << 20  # what a Python worker may hold of pieces it has encoded
ENTRY_BYTES = 128  # of one of them: its place, size and use, and its share of the table made for a lookup
CACHE_CHARS = 64  # longer pieces are not remembered
ENCODE_BYTES = 4 << 20  # of text encoded at once: equal chunks are looked up once


def byte_alphabet() -> np.ndarray:
    """The code point by which the byte-level alphabet writes each byte."""
    own = np.zeros(256, dtype=bool)
    own[33:127] = own[161:173] = own[174:256] = True
    return np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")


class Encoder:
    """Encodes texts with a tokenizer file of the `tokenizers` library, adding no special tokens.

    The byte-level pattern never joins characters across the start of a chunk as ``_chunk`` cuts
    them: a run of non-space characters with at most one space before it, or white space. So
    where the file has that pattern, a text's ids are its chunks' ids one after the other. A chunk that is
    a word and marks after it is two pieces for that pattern, too; others are one piece. Each different piece
    is encoded once per worker (up to a bound in bytes, beyond which the half that is met least is
    forgotten), by the file's model alone where the pattern would take it whole. Files with another pattern are encoded text by text, and so are texts that hold the
    string of one of the file's added tokens, which the library cuts out before the pattern applies;
    ``plain`` makes those strings ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a chunk holds no added token but in plain texts
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                         and not spec.get("normalizer"))
        self.added = [t["content"] for t in spec.get("added_tokens", []) if not (plain and t["special"])]
        self._chunk = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        newline = self._ids("\n")
        self.newline = int(newline[0]) if len(newline) == 1 else None
        vocab = self.tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)  # of text that an id stands for
        self._bytes[list(vocab.values())] = list(map(len, vocab))
        self._alphabet = byte_alphabet()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        # pieces in memory, the empty one first, their ids one after the other, and in how many slices each was met
        self._pieces, self._flat = pa.array([""]), np.zeros(0, dtype="<u4")
        self._sizes, self._uses, self.held = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), ENTRY_BYTES

    @property
    def known(self) -> dict[str, bytes]:
        """The pieces in memory and their ids."""
        ends = np.cumsum(self._sizes).tolist()
        return {c: self._flat[a:b].tobytes() for c, a, b in zip(self._pieces.to_pylist(), [0, *ends], ends)}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keep short pieces while there is room for them; of those met equally often the first stay."""
        cost = ENTRY_BYTES + pc.binary_length(pieces).to_numpy() + 4 * sizes
        short = pc.less_equal(pc.utf8_length(pieces), CACHE_CHARS).to_numpy(zero_copy_only=False)
        if self.held + int(cost[short].sum()) > CACHE_BYTES and len(self._pieces) > 1:
            keep = np.zeros(len(self._pieces), dtype=bool)
            keep[1 + np.argsort(-self._uses[1:], kind="stable")[:len(keep) // 2]] = keep[0] = True
            self._flat, self._sizes = self._flat[np.repeat(keep, self._sizes)], self._sizes[keep]
            self._pieces, self._uses = self._pieces.filter(pa.array(keep)), (self._uses[keep] + 1) // 2
            self.held = ENTRY_BYTES * len(self._pieces) + 4 * len(self._flat) + pc.sum(pc.binary_length(self._pieces)).as_py()
        short &= np.cumsum(np.where(short, cost, 0)) <= CACHE_BYTES - self.held
        self.held += int(cost[short].sum())
        self._pieces = pa.concat_arrays([self._pieces, pieces.filter(pa.array(short))])
        self._flat = np.concatenate((self._flat, flat[np.repeat(short, sizes)]))
        self._sizes = np.concatenate((self._sizes, sizes[short]))
        self._uses = np.concatenate((self._uses, np.ones(int(short.sum()), dtype=np.int64)))

    def _whole_pieces(self, pieces: pa.Array, step: int = 200) -> tuple[np.ndarray, np.ndarray] | None:
        """(flat, sizes): the ids of pieces that the pattern takes whole, by the model, which reads them in the byte-level alphabet.
        None where the ids don't stand for just these bytes."""
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_buffer(), dtype="u1")
        codes = self._alphabet[data]
        gaps = ends[:-1] + np.arange(len(ends) - 1)
        codes[gaps] = 32
        text = codes.tobytes().decode("utf-32-le")
        cuts = [0, *(gaps[step - 1::step] + 1).tolist(), len(text) + 1]
        ids = np.fromiter(chain.from_iterable(self.model.encode_batch_fast([text[a:b - 1]], add_special_tokens=False)[0].ids
                                              for a, b in zip(cuts, cuts[1:])), dtype="<u4")
        through = np.cumsum(self._bytes[ids])
        past = np.searchsorted(through, ends, "right")
        if len(through) == 0 or (past == 0).any() or not np.array_equal(through[past - 1], ends) or through[-1] != ends[-1]:
            return None
        return ids, np.diff(past, prepend=0)

    def _learn(self, chunks: list[str], step: int = 4000) -> list[bytes]:
        """Encode different chunks joined by newlines, which the pattern keeps as tokens of their own."""
        out: list[bytes] = []
        for i in range(0, len(chunks), step):
            part = chunks[i:i + step]
            text = "\n".join(part)
            # a chunk of white space would run into the newline beside it
            if self.newline is None or any(map(str.isspace, part)):
                plain = [c for c in part if not c.isspace()]
                if self.newline is None or not plain:
                    out.extend(self._one_by_one(part))
                else:
                    blank = [c for c in part if c.isspace()]
                    known = dict(zip(blank, self._one_by_one(blank))) | dict(zip(plain, self._learn(plain, step)))
                    out.extend(map(known.__getitem__, part))
                continue
            ids = self._ids(text)
            cut = np.flatnonzero(ids == self.newline)
            if len(cut) != len(part) - 1:
                out.extend(self._one_by_one(part))
                continue
            data = ids.tobytes()
            starts, ends = [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(data)]
            out.extend([data[s:e] for s, e in zip(starts, ends)])
        return out

    def _new_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat, sizes): the ids of different pieces, encoded now."""
        whole = pc.match_substring_regex(pieces, _WHOLE)
        got = self._whole_pieces(pieces.filter(whole)) if pc.any(whole).as_py() else None
        if got is None:
            whole = pa.array(np.zeros(len(pieces), dtype=bool))
            got = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        whole = whole.to_numpy(zero_copy_only=False)
        if whole.all():
            return got
        rest = self._learn(pieces.filter(pa.array(~whole)).to_pylist())
        flat = np.concatenate((got[0], np.frombuffer(b"".join(rest), dtype="<u4")))
        sizes = np.concatenate((got[1], np.fromiter(map(len, rest), dtype=np.int64, count=len(rest)) // 4))
        place = np.empty(len(pieces), dtype=np.int64)
        place[np.concatenate((np.flatnonzero(whole), np.flatnonzero(~whole)))] = np.arange(len(pieces))
        return _runs(flat, np.cumsum(sizes) - sizes, sizes, place), sizes[place]

    def _ids_of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat, sizes): the ids of chunks one after the other, from memory or encoded now."""
        head = pc.ascii_rtrim(chunks, characters=_MARKS)
        size = pc.binary_length(chunks).to_numpy()
        first = np.where(pc.match_substring_regex(head, _WORD).to_numpy(zero_copy_only=False), pc.binary_length(head).to_numpy(), size)
        offsets = np.zeros(2 * len(chunks) + 1, dtype=np.int32)
        np.cumsum(np.stack((first, size - first), axis=1).ravel(), out=offsets[1:])
        data = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "")[0].as_buffer()
        coded = pa.StringArray.from_buffers(2 * len(chunks), pa.py_buffer(offsets), data).dictionary_encode()
        pieces = coded.dictionary
        at = pc.fill_null(pc.index_in(pieces, value_set=self._pieces), -1).to_numpy().astype(np.int64)
        gap = at < 0
        self._uses[at[~gap]] += 1
        flat, sizes = self._flat, self._sizes
        if gap.any():
            new = pieces.filter(pa.array(gap))
            more = self._new_pieces(new)
            at[gap] = len(sizes) + np.arange(len(new))
            flat, sizes = np.concatenate((flat, more[0])), np.concatenate((sizes, more[1]))
            self._remember(new, *more)
        at = at[coded.indices.to_numpy()]
        return _runs(flat, np.cumsum(sizes) - sizes, sizes, at), sizes[at].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text is empty."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        column = pc.fill_null(column, "")
        if not self.by_chunk:
            return self._one_by_one(column.to_pylist())
        cut = np.zeros(len(column), dtype=bool)
        for token in self.added:
            cut |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not cut.any():
            return self._by_chunk(column)
        out = self._by_chunk(pc.if_else(pa.array(cut), "", column))
        at = np.flatnonzero(cut)
        for i, ids in zip(at.tolist(), self._one_by_one(column.take(pa.array(at)).to_pylist())):
            out[i] = ids
        return out

    def _by_chunk(self, column: pa.Array) -> list[bytes]:
        """Texts whose only white space is single blanks and newlines are cut by Arrow, the others by the
        pattern; then every different chunk is looked up once."""
        odd = pc.match_substring_regex(column, _ODD)
        marked = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        pieces = pc.split_pattern(pc.if_else(odd, "", marked), "\0")
        chunks, cuts = pieces.flatten(), pieces.offsets.to_numpy()
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        apart = [self._chunk.findall(column[i].as_py()) for i in at]
        more = list(accumulate(map(len, apart), initial=len(chunks)))
        if at:
            chunks = pa.concat_arrays([chunks, pa.array(chain.from_iterable(apart), pa.string())])
        if not len(chunks):
            return [b""] * len(column)
        coded = chunks.dictionary_encode()
        flat, sizes = self._ids_of_chunks(coded.dictionary)
        chunk = coded.indices.to_numpy()
        data = _runs(flat, np.cumsum(sizes) - sizes, sizes, chunk).tobytes()
        through = np.concatenate(([0], 4 * np.cumsum(sizes[chunk])))
        ends = through[cuts].tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        ends = through[more].tolist()
        for i, a, b in zip(at, ends, ends[1:]):
            out[i] = data[a:b]
        return out


def _runs(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start at ``first`` and have ``sizes``, in the order of their numbers in ``at``."""
    each = sizes[at]
    through = np.cumsum(each)
    total = int(through[-1]) if len(at) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((first[at] - through + each).astype(kind), each) + np.arange(total, dtype=kind)]


def encoder(path: str, plain: bool = False) -> Encoder:
    """This Python worker's encoder for a tokenizer file."""
    held = sys.__dict__.setdefault("_tessera_encoders", {})  # outlives the task, as the worker does
    if (path, plain) not in held:
        held[path, plain] = Encoder(path, plain)
    return held[path, plain]

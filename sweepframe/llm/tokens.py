"""Token ids by the `tokenizers` library, with a bounded memory of piece encodings per worker.

The vocabularies used here split a text before white space, and between a letter and a
punctuation mark, before they do anything else. So the ids of a text are the ids of its pieces
in order. A piece is encoded by the library when a worker first meets it; later it is found by
a 64-bit hash, computed for all pieces of a batch at once, and its bytes are compared with
those remembered, so pieces of equal hashes are told apart. Texts with white space outside
ASCII, or with characters whose normal form depends on what stands before, go through the
library as a whole. So does every text of a vocabulary that fails a trial of the cuts."""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WHITE, _MARK, _LETTER, _LEAD = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[list(b",.!?;:|$%&*()")] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[0, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xCE, 0xE1, 0xE2, 0xE3]] = _LEAD
#: First bytes of UTF-8 sequences that make a text take the whole way (after _LEAD).
_ODD = (b"\x00", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xce\xa3", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_BLOCK = 1 << 18
#: What the cuts are tried on: every kind of cut beside every kind of sign.
_TRIAL = "".join(f"{a}{b}{c}x" for a in ("word", "Z", "9", "é", "²", "'s", "\n", " ", "..") for b in (" ", "  ", "\t", "\r\n", ",", ".", "!", "?", ";", ":", "|", "$", "%", "&", "*", "(", ")") for c in ("a", "7", "ß", "-", "", " b"))


class _Pool:
    """A growing array; stretches of it are added and taken."""

    def __init__(self, kind: type):
        self.data, self.filled = np.zeros(1 << 20, kind), 0

    def add(self, values: np.ndarray) -> int:
        while self.filled + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        base, self.filled = self.filled, self.filled + len(values)
        self.data[base : self.filled] = values
        return base

    def take(self, off: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        return self.data[_ragged(off, cnt)]


class _Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of bytes, from one running sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 1 << 61)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def stretches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(n + 1, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[:n], out=run[1:])
        h = (run[end] - run[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


class Encoder:
    """separator: a text that the vocabulary always encodes as the one id separator_id when it
    stands between two pieces. most: pieces remembered, of 32 bytes on average; beyond it those
    not met again go."""

    def __init__(self, path: str, separator: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.separator, self.mark, self.most = separator, separator.strip(" "), most
        (self.separator_id,) = self.model.encode(separator, add_special_tokens=False).ids
        self.hashes = _Hashes(1)
        self._clear()
        self.cuts = True
        raw = np.frombuffer(_TRIAL.encode(), np.uint8)
        self.cuts = np.array_equal(self.encode(raw, np.array([0, len(raw)]))[0], self.whole([_TRIAL])[0])

    def _clear(self) -> None:
        size = 1 << (2 * self.most - 1).bit_length()
        self.shift, self.mask = np.uint64(65 - size.bit_length()), size - 1
        self.key = np.zeros(size, np.uint64)
        self.off, self.cnt = np.zeros(size, np.int32), np.zeros(size, np.int32)  # of its ids
        self.at, self.length = np.zeros(size, np.int32), np.zeros(size, np.int32)  # of its bytes
        self.again = np.zeros(size, bool)
        self.ids, self.raw, self.entries = _Pool(np.uint32), _Pool(np.uint8), 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for unknown ones."""
        found, at = np.full(len(key), -1, np.int64), np.arange(len(key))
        slot = (key >> self.shift).astype(np.int64)
        while len(at):
            here = self.key[slot]
            same = here == key[at]
            found[at[same]] = slot[same]
            on = (here != 0) & ~same
            at, slot = at[on], (slot[on] + 1) & self.mask
        return found

    def _put(self, key: np.ndarray, ids: np.ndarray, cnt: np.ndarray, raw: np.ndarray, length: np.ndarray) -> None:
        """Add distinct keys that are not there yet, with their ids and bytes one behind the other."""
        off, place = self.ids.add(ids) + np.cumsum(cnt) - cnt, self.raw.add(raw) + np.cumsum(length) - length
        at, slot = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(at):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[at[free]]
            mine = free & (self.key[slot] == key[at])
            to, of = slot[mine], at[mine]
            self.off[to], self.cnt[to], self.at[to], self.length[to] = off[of], cnt[of], place[of], length[of]
            at, slot = at[~mine], (slot[~mine] + 1) & self.mask
        self.entries += len(key)

    def _full(self, more: int, more_bytes: int) -> bool:
        return self.entries + more > self.most or self.raw.filled + more_bytes > 32 * self.most

    def _shrink(self) -> None:
        """Forget all pieces but those met again, and of these all beyond half of `most`."""
        keep = np.flatnonzero(self.again)[: self.most // 2]
        keep = keep[np.cumsum(self.length[keep]) <= 16 * self.most]
        key, cnt, length = self.key[keep], self.cnt[keep], self.length[keep]
        ids, raw = self.ids.take(self.off[keep], cnt), self.raw.take(self.at[keep], length)
        self._clear()
        self._put(key, ids, cnt, raw, length)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces, and how many each has, from the library: plain pieces in one text, the others alone."""
        raw = data.tobytes()
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
        plain = np.array([self.mark not in p and not p[-1:].isspace() for p in pieces], bool)
        cnt, parts = np.zeros(len(pieces), np.int64), [np.empty(0, np.uint32)]
        if plain.any():
            joined = self.whole([self.separator.join([p for p, ok in zip(pieces, plain) if ok])])[0]
            cuts = np.flatnonzero(joined == self.separator_id)
            if len(cuts) == plain.sum() - 1:
                cnt[plain] = np.diff(np.concatenate([[-1], cuts, [len(joined)]])) - 1
                parts.append(joined[joined != self.separator_id])
            else:
                plain[:] = False
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        if not plain.all():
            alone = self.whole([p for p, ok in zip(pieces, plain) if not ok])
            cnt[~plain] = [len(x) for x in alone]
            parts += alone
        off = np.empty(len(pieces), np.int64)
        off[order] = np.cumsum(cnt[order]) - cnt[order]
        return np.concatenate(parts)[_ragged(off, cnt)], cnt

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of consecutive pieces, and how many each has."""
        a, n = int(start[0]), int(end[-1])
        part, start, end = data[a:n], start - a, end - a
        key = self.hashes.stretches(part, start, end) | np.uint64(1)
        slot = self._find(key)
        self.again[slot[slot >= 0]] = True
        shrunk = False
        while len(new := np.flatnonzero(slot < 0)):
            new = new[np.unique(key[new], return_index=True)[1]]
            size = end[new] - start[new]
            if not shrunk and self._full(len(new), int(size.sum())):
                self._shrink()  # takes known pieces of this block, too, so look again
                shrunk = True
            else:
                self._put(key[new], *self._by_library(part, start[new], end[new]), part[_ragged(start[new], size)], size)
            slot = self._find(key)
        size, cnt = end - start, self.cnt[slot].astype(np.int64)
        other = self.length[slot] != size
        if not other.any():
            wrong = self.raw.take(self.at[slot], size) != part
            if not wrong.any():
                return self.ids.take(self.off[slot], cnt), cnt
            other[np.searchsorted(start, np.flatnonzero(wrong), "right") - 1] = True
        else:
            other = np.array([not np.array_equal(self.raw.data[x : x + m], part[b:e]) for x, m, b, e in zip(self.at[slot].tolist(), self.length[slot].tolist(), start.tolist(), end.tolist())], bool)
        odd = np.flatnonzero(other)  # pieces whose hashes are another piece's
        cnt[odd] = 0
        known = np.split(self.ids.take(self.off[slot], cnt), np.cumsum(cnt)[:-1])
        ids, of = self._by_library(part, start[odd], end[odd])
        for i, own in zip(odd.tolist(), np.split(ids, np.cumsum(of)[:-1])):
            known[i] = own
        cnt[odd] = of
        return np.concatenate(known), cnt

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts data[offsets[i]:offsets[i + 1]] (UTF-8), one behind the other, and the ids' own offsets."""
        n_docs, lo = len(offsets) - 1, int(offsets[0])
        data, offsets = data[lo : int(offsets[-1])], np.asarray(offsets, np.int64) - lo
        lengths = np.zeros(n_docs, np.int64)
        kind = _KIND[data]
        odd = self._odd(data, kind, offsets) if self.cuts else set(range(n_docs))
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ((kind[1:] == _WHITE) & (kind[:-1] != _WHITE)) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        doc = np.searchsorted(offsets, edges[:-1], "right") - 1
        out, i = [], 0
        while i < len(edges) - 1:
            d = doc[i]
            if d in odd:
                ids = self.whole([data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")])[0]
                lengths[d] += len(ids)
                j = int(np.searchsorted(edges, offsets[d + 1]))
            else:
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + _BLOCK, "right")) - 1)
                j = min(j, i + self.most)  # a block's pieces fit the table beside those kept
                if odd and (k := np.flatnonzero(np.isin(doc[i:j], list(odd)))).size:
                    j = i + int(k[0])
                ids, cnt = self._pieces(data, edges[i:j], edges[i + 1 : j + 1])
                first = doc[i]
                sums = np.bincount(doc[i:j] - first, cnt).astype(np.int64)
                lengths[first : first + len(sums)] += sums
            out.append(ids)
            i = j
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.concatenate([[0], np.cumsum(lengths)])

    @staticmethod
    def _odd(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> set[int]:
        at = np.flatnonzero(kind == _LEAD)
        if len(at):
            hit = np.zeros(len(at), bool)
            for seq in _ODD:
                ok = at <= len(data) - len(seq)
                for k, byte in enumerate(seq):
                    ok[ok] = data[at[ok] + k] == byte
                hit |= ok
            at = at[hit]
        return set((np.searchsorted(offsets, at, "right") - 1).tolist())


def _ragged(off: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Indexes off[0]..off[0]+cnt[0]-1, off[1].. and so on."""
    before = np.cumsum(cnt) - cnt
    return np.repeat(off - before, cnt) + np.arange(int(cnt.sum()))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)), offsets


_ENCODERS: dict = {}


def encoder(path: str, separator: str) -> Encoder:
    """One per worker process, kept between tasks."""
    if (path, separator) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, separator] = Encoder(path, separator)
    return _ENCODERS[path, separator]

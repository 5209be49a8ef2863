"""Token ids of whole texts with a byte-level BPE vocabulary, worked out on the UTF-8 buffer of an Arrow column.

The vocabulary's pre-tokeniser puts a boundary in front of each space that follows a non-space character, on
both sides of a line end between two non-space characters, and between a letter or digit and the ASCII sign
after it.  A text may be cut at any of these and its pieces encoded alone.  A name of an added token in a text is that
token, and the parts between such names are encoded alone; a parameter makes the names ordinary text.  Pieces repeat a lot: a worker keeps
the ids of those it has seen in arrays of bounded size, looked up by 64-bit hash, and only new pieces go through
the merge table, which is read from the same vocabulary file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import wordbytes as wb

#: A worker forgets its pieces when it has more than this.
KNOWN_MOST = 300_000
#: Bytes of text encoded at a time.
STEP_BYTES = 1 << 19
#: Fixed pattern of the byte-level pre-tokeniser.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def _flags(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


_WHITE = _flags((9, 13), (32, 32))
_ALNUM = _flags((48, 57), (65, 90), (97, 122))
_SIGN = _flags((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))  # ASCII signs but the apostrophe
_CONTINUED = _flags((0x80, 0xBF))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _odd_white(data: np.ndarray) -> np.ndarray:
    """Positions of white space characters outside ASCII: in such rows a space may follow white space unseen."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return at
    end = len(data) - 1
    b, c = data[np.minimum(at + 1, end)], data[np.minimum(at + 2, end)]
    a = data[at]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[odd]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces; every non-empty row starts one."""
    before = np.empty_like(data)
    before[0], before[1:] = 32, data[:-1]
    white, white_before = _WHITE[data], _WHITE[before]
    line = (data == 10) & ~white_before
    line[:-1] &= ~white[1:]
    line[-1] = False
    cut = (data == 32) & ~white_before | line
    cut[1:] |= line[:-1]
    letter = _ALNUM[before]
    lead = np.empty_like(data)
    lead[:2], lead[2:] = 0, data[:-2]
    letter |= (lead == 0xC3) & _CONTINUED[before] & (before != 0x97) & (before != 0xB7)
    cut |= _SIGN[data] & letter
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """The ids of texts.  named: the names of added tokens in a text are those tokens, else ordinary text."""

    def __init__(self, path: str, named: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, added = _byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.merges = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.added = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])} if named else {}
        self.names = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.newline = ranks[b"\n"]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces (none known yet) to the arrays.  Plain ones are encoded in one call, parted by line ends."""
        texts = [p.decode() for p in pieces]
        plain = [i for i, t in enumerate(texts) if (t if t[0] != " " else t[1:]).split() == [t[1:] if t[0] == " " else t]]
        rest = sorted(set(range(len(texts))) - set(plain)) if len(plain) < len(texts) else []
        ids = np.asarray(self.merges.encode_ordinary("\n".join([texts[i] for i in plain])), np.uint32) if plain else np.zeros(0, np.uint32)
        lines = ids == self.newline
        alone = [self.merges.encode_ordinary(texts[i]) for i in rest]
        count = np.empty(len(texts), np.int64)
        count[plain] = np.diff(np.concatenate([[-1], np.flatnonzero(lines), [len(ids)]])) - 1 if plain else 0
        count[rest] = [len(x) for x in alone]
        order = np.array(plain + rest, np.int64)
        begin = np.empty(len(texts), np.int64)
        begin[order] = len(self.flat) + np.cumsum(count[order]) - count[order]
        self.flat = np.concatenate([self.flat, ids[~lines], *(np.asarray(x, np.uint32) for x in alone)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        starts = _cuts(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        key = wb.spans(data, starts, starts + lengths)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN_MOST:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[s : s + n] for s, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        begin, count = self.begin[at][back], self.count[at][back]
        ends = np.cumsum(count)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends + count, count)]
        upto = np.concatenate([[0], ends])
        return ids, upto[np.searchsorted(starts, offsets)] if rows else upto[:1]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text without odd white space, in parts of about STEP_BYTES that end where a piece does."""
        if len(data) <= 2 * STEP_BYTES:
            return self._step(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint32)
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > 2 * STEP_BYTES:
                # The last piece may go on in the next part, and with it a line end before it.
                starts = _cuts(data[at : at + STEP_BYTES], np.array([0, STEP_BYTES]))
                starts = starts[(starts > 0) & (starts < STEP_BYTES - 2)]
                if len(starts):
                    end = at + int(starts[-1])
            out.append(self._step(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)

    def _alone(self, text: bytes) -> np.ndarray:
        """The ids of one text, by the merge table where it has odd white space."""
        data = np.frombuffer(text, np.uint8)
        if len(_odd_white(data)):
            return np.asarray(self.merges.encode_ordinary(text.decode()), np.uint32)
        return self._long(data)

    def _with_names(self, text: bytes) -> np.ndarray:
        """The ids of one text, cut at the names of added tokens."""
        out, at = [], 0
        for m in self.names.finditer(text):
            out += [self._alone(text[at : m.start()]), np.array([self.added[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._alone(text[at:])])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids before each row and after the last)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        odd = _odd_white(data)
        slow = set(np.searchsorted(offsets, odd, side="right") - 1)
        named = self.names is not None and self.names.search(memoryview(data)) is not None
        if not slow and not named and len(data) <= 2 * STEP_BYTES:
            return self._step(data, offsets)
        parts, counts = [], []
        for r in range(len(offsets) - 1):
            part = data[offsets[r] : offsets[r + 1]]
            if named and self.names.search(memoryview(part)):
                ids = self._with_names(part.tobytes())
            else:
                ids = self._alone(part.tobytes()) if r in slow else self._long(part)
            parts.append(ids)
            counts.append(len(ids))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def encoder(path: str, named: bool = True) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    if (path, named) not in _encoders:
        _encoders[path, named] = PieceEncoder(path, named)
    return _encoders[path, named]


def encoded(batch: pa.RecordBatch, path: str, named: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids before each row) in steps of bounded size over the batch's texts."""
    enc = encoder(path, named)
    for first, end, data, offsets in wb.steps(batch.column("text"), STEP_BYTES):
        yield first, end, *enc.rows(data, offsets)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))

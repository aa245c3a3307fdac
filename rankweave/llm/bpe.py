"""Byte-level BPE in batched numpy merge rounds.

The symbols of all words of a batch lie in one flat array. A round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes the lowest rank within each word, and merges
all its occurrences there from left to right. Words without a mergeable pair leave the array, so
rounds get shorter. Results of words are kept in a table of bounded size between batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankweave.llm.scratch import small_batches

#: The published pre-tokenisation pattern of the byte-level vocabulary (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose encodings are kept between batches; beyond this the table is emptied.
KEPT_WORDS = 500_000
#: Characters of text whose words are encoded together.
GROUP_CHARS = 1 << 20
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: printable Latin-1 bytes
    stand for themselves, the others in order for the characters from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one vocabulary file in the JSON format of the tokenizers library.

    The unit kept between batches is a *chunk*: what lies between two single spaces. The pattern starts a
    new word at a space that stands between non-spaces, so chunks are tokenised on their own; a text with
    a space beside other white space is tokenised as a whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)} | {i: t.encode() for t, i in self.special.items()}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(self.base)]
        self.digits = [str(i) for i in range(self.base)]
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.words = regex.compile(WORD_PATTERN)
        self.mixed_space = regex.compile(r"(?:^|\s) | (?:\s|$)")
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after another, number of ids of each); words are not empty."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(size):
            return np.zeros(0, np.int32), size
        name = np.arange(len(words))  # the words still in the array
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        start = np.cumsum(size) - size
        last = np.zeros(len(sym), dtype=bool)
        last[start + size - 1] = True
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        open_ = np.flatnonzero(~last)
        rank[open_] = self._rank(sym[open_], sym[open_ + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(name):
            low = np.minimum.reduceat(rank, start)
            over = low == NO_RANK
            if over.any():
                gone = np.repeat(over, size)
                done.append((name[over], size[over], sym[gone].astype(np.int32)))
                sym, rank, last = sym[~gone], rank[~gone], last[~gone]
                name, size, low = name[~over], size[~over], low[~over]
                start = np.cumsum(size) - size
                if not len(name):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # in a run of overlapping hits (one symbol repeated) every second one merges
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = np.diff(at) > 1
            if not fresh.all():
                at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            word = np.searchsorted(start, at, side="right") - 1
            size = size - np.bincount(word, minlength=len(size))
            start = np.cumsum(size) - size
            new = at - np.arange(len(at))
            sym, rank, last = sym[keep], rank[keep], last[keep]
            rank[new] = NO_RANK
            touched = np.concatenate((new, new[new > 0] - 1))
            touched = touched[~last[touched]]
            rank[touched] = self._rank(sym[touched], sym[touched + 1])
        names, sizes = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        flat = np.concatenate([d[2] for d in done])
        order = np.argsort(names)
        return flat[_spread((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def _learn(self, chunks: list[str], spaced: bool) -> None:
        """Put the encodings of chunks (with the space before each, if spaced) into the table."""
        if not chunks:
            return
        if spaced:  # one match over all of them: a word that begins with a space begins a chunk
            words = self.words.findall(" " + " ".join(chunks))
            owner = np.cumsum([w[0] == " " for w in words]) - 1
        else:
            split = [self.words.findall(c) for c in chunks]
            words = [w for s in split for w in s]
            owner = np.repeat(np.arange(len(chunks)), [len(s) for s in split])
        ids, n = self.encode_words([w.encode() for w in words])
        size = np.bincount(owner, weights=n, minlength=len(chunks)).astype(np.int64)
        known = len(self.size)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids))
        self.slot.update(zip(chunks if spaced else ("\n " + c for c in chunks), range(known, known + len(chunks)), strict=True))

    def _chunks(self, text: str) -> list[str]:
        """Keys of the table for a text without special tokens; keys of stretches without a space before
        them begin with a line break and a space, which no other key contains."""
        if not text:
            return []
        if self.mixed_space.search(text):
            return ["\n " + w for w in self.words.findall(text)]
        first, *rest = text.split(" ")
        return ["\n " + first, *rest]

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The token ids of each text."""
        for group in _groups(texts):
            keys: list[str] = []
            bounds = [0]
            for t in group:
                if self.split is None or self.split.search(t) is None:
                    keys += self._chunks(t)
                else:
                    for k, part in enumerate(self.split.split(t)):
                        keys += [f"\n {self.special[part]} special"] if k % 2 else self._chunks(part)
                bounds.append(len(keys))
            fresh = set(keys) - self.slot.keys()
            if len(self.slot) + len(fresh) > KEPT_WORDS:
                self._forget()
                fresh = set(keys)
            for key in [k for k in fresh if k.endswith(" special") and k.startswith("\n ")]:
                fresh.remove(key)
                self.slot[key] = len(self.size)
                self.start, self.size = np.append(self.start, len(self.flat)), np.append(self.size, 1)
                self.flat = np.append(self.flat, np.int32(key[2:].split(" ")[0]))
            self._learn([k for k in fresh if not k.startswith("\n ")], True)
            self._learn([k[2:] for k in fresh if k.startswith("\n ")], False)
            at = np.fromiter(map(self.slot.__getitem__, keys), dtype=np.int64, count=len(keys))
            size = self.size[at]
            ids = self.flat[_spread(self.start[at], size)]
            ends = np.concatenate(([0], np.cumsum(size)))[bounds]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_texts([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that do not form a character become U+FFFD, an id without a token nothing."""
        n = self.base
        if ids and (min(ids) < 0 or max(ids) >= n):
            ids = [i for i in ids if 0 <= i < n]
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def joined(self, ids: list[int]) -> str:
        """ids in decimal, joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start[k], start[k] + 1, ... of size[k] entries each, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= GROUP_CHARS:
            yield group
            group, n = [], 0
    if group:
        yield group


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The codec of a vocabulary file, built once per Python worker."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the text decoded from them.

    A null or empty text has no tokens. Special tokens of the vocabulary are recognised in texts.
    Rows are handled one by one, so null ids and rows that repeat an id keep their own results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in _slices(batch):
                n, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_texts(_texts(part.column(1))):
                    ids = ids.tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the token ids of each text as an array column (null or empty text: no ids); a column named out_col is replaced."""
    docs = docs.drop(out_col)
    names, at = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in _slices(batch):
                ids = list(bpe.encode_texts(_texts(part.column(at))))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[*names, out_col])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of an id array column (null: empty text); a column named out_col is replaced."""
    rows = rows.drop(out_col)
    names, at = rows.columns, rows.columns.index(ids_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(x or []) for x in part.column(at).to_pylist()], pa.string())], names=[*names, out_col])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)

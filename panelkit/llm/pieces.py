"""Merge-type piece encoding by backtracking, and the inverse.

A text is cut where no piece can reach across (before a word mark that follows
another character, around characters that occur in no piece). A chunk is encoded
left to right: an Aho-Corasick pass gives the longest piece at each start; a piece
is kept if it agrees with the one before, that is if merging their joint characters
anew gives just the two; otherwise its next shorter prefix is tried, and where none
is left the position is marked as failed in a bit field and the last piece is
taken back. The pieces of neighbours agree everywhere exactly in the encoding that
greedy merging gives, so no merge queue over the text is needed.

Defined results: a null text counts as empty, an empty text has the begin and end
ids only; rows repeat as they are given; an empty table gives an empty table. Other
columns of the input, whatever their names, are not carried unless named as ``id``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
# Chunks kept with their ids by each Python worker; when full, all are forgotten.
CACHED_CHUNKS = 300_000
BREAKS = "\n\r\t"


def merged(chars: list[str], scores: dict[str, float]) -> list[str]:
    """Greedy merging: always the best-scored adjacent pair, leftmost of equals."""
    parts: list[str | None] = list(chars)
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        joint = parts[i] + parts[j]
        if joint in scores:
            heapq.heappush(heap, (-scores[joint], i, j, joint))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, joint = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != joint:
            continue
        parts[i], parts[j] = joint, None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            offer(i, right[j])
        if left[i] >= 0:
            offer(left[i], i)
    return [p for p in parts if p is not None]


class Encoder:
    """Encodes and decodes as the model file says; holds the tables of one worker."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int],
                 skipped: set[int], bos: int, eos: int, dummy_prefix: bool = True,
                 unknown: tuple[int, str] = (-1, "")):
        self.pieces, self.bos, self.eos, self.dummy = pieces, bos, eos, dummy_prefix
        special = skipped | set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        alphabet = set().union(*self.ids) if self.ids else set()
        if loose := [c for c in alphabet if c not in self.ids]:
            raise ValueError(f"characters without a piece of their own: {loose[:5]!r}")
        self.alphabet = alphabet
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark after another character")
        self.byte_ids = byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.text_of = ["" if i in special else p.replace(MARK, " ") for i, p in enumerate(pieces)]
        self.unknown = unknown[0]
        if unknown[0] >= 0:
            self.text_of[unknown[0]] = unknown[1]
        # The longest piece that is a proper prefix, by id; -1: none.
        self.shorter = [-1] * len(pieces)
        self.trie = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.trie.add_word(p, (i, len(p)))
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.trie.make_automaton()
        breaks = "".join(c for c in BREAKS if c not in alphabet)
        self.chunks = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|[{breaks}]" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.agree: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def agrees(self, first: int, second: int) -> bool:
        """Whether merging the characters of both anew gives just the two."""
        known = self.agree.get((first, second))
        if known is None:
            a = self.pieces[first] if first >= 0 else ""
            b = self.pieces[second]
            known = merged(list(a + b), self.scores) == ([a, b] if a else [b])
            if len(self.agree) >= CACHED_CHUNKS:
                self.agree.clear()
            self.agree[first, second] = known
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters have pieces."""
        n, pieces, shorter, agrees = len(text), self.pieces, self.shorter, self.agrees
        longest, size = [-1] * n, [0] * n
        for end, (i, length) in self.trie.iter(text):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = i, length
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + len(pieces[token])
                if not failed[end >> 3] >> (end & 7) & 1 and agrees(last, token) and (last < 0 or agrees(-1, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(pieces[token])
                token = shorter[token]
        return out

    def _chunk(self, chunk: str) -> bytes:
        out: list[int] = []
        start, alphabet = 0, self.alphabet
        for k, c in enumerate(chunk):
            if c not in alphabet:
                if start < k:
                    out += self._known(chunk[start:k])
                out += [self.byte_ids[b] for b in c.encode()]
                start = k + 1
        if start < len(chunk):
            out += self._known(chunk[start:] if start else chunk)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids with the begin and end ids, as little-endian unsigned 32-bit integers."""
        if text:
            text = (MARK if self.dummy else "") + text.replace(" ", MARK)
        cache, parts = self.cache, []
        for chunk in self.chunks(text):
            ids = cache.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(cache) >= CACHED_CHUNKS:
                        cache.clear()
                    cache[chunk] = ids
            parts.append(ids)
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        return np.frombuffer(ends[:4] + b"".join(parts) + ends[4:], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined to characters (each byte that fits none
        becomes U+FFFD), marks become spaces, the added one goes."""
        byte_of, out, held = self.byte_of, [], bytearray()
        texts = list(map(self.text_of.__getitem__, ids.tolist()))
        lo, hi = (min(self.byte_ids), max(self.byte_ids)) if self.byte_ids else (1, 0)
        odd = np.flatnonzero((ids >= lo) & (ids <= hi)).tolist()
        if odd:
            run: list[int] = []
            for k, at in enumerate(odd):
                run.append(at)
                if k + 1 == len(odd) or odd[k + 1] != at + 1:
                    held = bytes(byte_of[int(ids[x])] for x in run)
                    texts[run[0]] = characters(held)
                    run = []
        joined = "".join(texts)
        first = next((k for k, t in enumerate(texts) if t), None)
        added = self.dummy and first is not None and texts[first].startswith(" ") and ids[first] != self.unknown
        return joined[1:] if added else joined


def characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[i:i + size].decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


@lru_cache(maxsize=2)
def load(model_path: str) -> Encoder:
    """Read a model file of the merge type with an identity normaliser."""
    pieces, scores, bytes_, skipped = [], [], {}, set()
    dummy, special, surface = True, {40: 0, 41: 1, 42: 2}, " \u2047 "
    with open(model_path, "rb") as file:
        for number, value in fields(file.read()):
            if number == 1:
                piece = dict(fields(value))
                text, kind = piece[1].decode(), piece.get(3, 1)
                if kind == 6:
                    bytes_[int(text[3:5], 16)] = len(pieces)
                elif kind != 1:
                    skipped.add(len(pieces))
                pieces.append(text)
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            elif number == 2:
                trainer = dict(fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a merge-type model")
                special |= {k: trainer[k] for k in special if k in trainer}
                surface = trainer[44].decode() if 44 in trainer else surface
            elif number == 3:
                rules = dict(fields(value))
                dummy = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps all spaces is covered")
    if len(bytes_) != 256:
        raise ValueError("the model has no byte pieces")
    return Encoder(pieces, scores, [bytes_[b] for b in range(256)], skipped, special[41], special[42], dummy,
                   (special[40], surface))


def encode_frame(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, ids (array<long>), decoded (string)."""
    kind = dict(docs.dtypes)[id]

    def run(batches):
        encoder = load(model_path)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch({
                "id": batch.column(0),
                "ids": pa.array([x.astype("i8") for x in ids], pa.list_(pa.int64())),
                "decoded": pa.array([encoder.decode(x) for x in ids], pa.string()),
            })

    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, ids array<long>, decoded string").withColumnRenamed("id", id)


def digest_frame(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256 — of what
    :func:`encode_frame` gives, digested where it arises so that ids and texts never
    travel back."""
    kind = dict(docs.dtypes)[id]

    def run(batches):
        encoder = load(model_path)
        for batch in batches:
            counts, id_digests, texts = [], [], []
            for t in batch.column(1):
                ids = encoder.encode(t.as_py() or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.record_batch({
                "id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(id_digests, pa.string()),
                "decoded_sha256": pa.array(texts, pa.string()),
            })

    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)

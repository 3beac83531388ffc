"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

The symbols of many distinct words lie in one flat array.  In each round the rank of every neighbouring pair is found by
binary search over the sorted pair keys of the vocabulary, every word merges all places of its lowest-ranked pair, left to
right, and words without a known pair leave the array.  Texts are cut into words by the byte-level pattern; the distinct
words of a task are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import lean, slices

NONE = np.int32(2**31 - 1)
#: Most words that a task keeps with their ids.
KEPT_WORDS = 1 << 18

#: The pattern of byte-level vocabularies, and the white space it knows.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The same for texts of characters below U+0250, whose letters and numbers are few ranges.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_LATIN = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")


@dataclass(frozen=True)
class Vocabulary:
    """Sorted pair keys with ranks and merged ids, the id of each byte, the bytes of each id, and whole-text tokens."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    pieces: tuple[bytes, ...]
    added: tuple[tuple[str, int], ...]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary in the tokenizers library's JSON format (on the driver; its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], _byte_letters()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys)
    added = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    pieces = [b""] * (max([*vocab.values(), *(i for _, i in added)]) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in token)
    for token, i in added:
        pieces[i] = token.encode()
    byte_ids = np.zeros(256, np.int32)
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    return Vocabulary(keys[order], np.arange(len(pairs), dtype=np.int32)[order], merged[order], byte_ids, tuple(pieces), tuple(added))


def encode_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each word (not empty) as little-endian 32-bit numbers."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        key = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = np.where((v.keys[at] == key) & (owner[:-1] == owner[1:]), v.ranks[at], NONE)
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(rank, new), np.diff(new, append=len(owner)))
        live = lowest != NONE
        if not live.all():
            done.append((owner[~live], symbols[~live]))
            if not live.any():
                break
        chosen = (rank == lowest) & live
        places = np.flatnonzero(chosen)
        run = np.flatnonzero(np.diff(places, prepend=-2) != 1)  # of overlapping pairs every second one merges
        places = places[(places - np.repeat(places[run], np.diff(run, append=len(places)))) % 2 == 0]
        symbols[places] = v.merged[at[places]]
        live[places + 1] = False
        symbols, owner = symbols[live], owner[live]
    owner, symbols = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(owner, kind="stable")
    raw = symbols[order].astype("<u4").tobytes()
    ends = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Encodes texts of one task; words met before come from a table of at most KEPT_WORDS."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.special = v, {}, {t: np.array([i], "<u4").tobytes() for t, i in v.added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t, _ in sorted(v.added, key=lambda x: -len(x[0]))) + ")") if v.added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        split, known, special = [], self.known, self.special
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(t in text for t in special) else (text,)
            words: list = []
            for part in parts:
                if part in special:
                    words.append((part,))
                elif part:
                    words += (_ANY if _BEYOND.search(part) else _LATIN).findall(part)
            split.append(words)
        fresh = list({w for words in split for w in words if w not in known})
        plain = [w for w in fresh if isinstance(w, str)]
        known.update((w, special[w[0]]) for w in fresh if not isinstance(w, str))
        known.update(zip(plain, encode_words([w.encode() for w in plain], self.v)))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def decode(ids: bytes, v: Vocabulary) -> str:
    """The text of ids (little-endian 32-bit); bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(v.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: (id, ids BINARY, n_tokens, decoded).  Null text: as empty, no ids.

    Narrow: no shuffle.  The vocabulary, whose size does not depend on the data, is broadcast.
    """
    return _run(docs, vocabulary_path, id_col, text_col, False)


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_decode`, with digests in place of ids and text: (id, n_tokens, ids_sha256, decoded_sha256)."""
    return _run(docs, vocabulary_path, id_col, text_col, True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(load(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = table.value
        encoder = Encoder(v)
        for batch in slices(batches, "text", 2 << 20):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            texts = [decode(x, v) for x in ids]
            out = {"id": batch.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if digests:
                out |= {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts]}
            else:
                out |= {"ids": ids, "decoded": texts}
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(rows), f"id {kind}, n_tokens long, {tail}").withColumnRenamed("id", id_col)

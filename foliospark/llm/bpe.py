"""Byte-level BPE: merges by a priority queue of ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import small_batches

#: Fixed value: the published split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker remembers, and the longest word it remembers.
CACHE_WORDS, CACHE_CHARS = 200_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next of U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return table


class Bpe:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, alphabet = spec["model"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.ranks = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.byte_id = [self.ids[alphabet[b]] for b in range(256)]
        self.bytes_of = {
            i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            for token, i in self.ids.items()
        }
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of |= {i: content.encode() for content, i in special.items()}
        names = sorted(special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, array] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in rank order, leftmost first among equals. O(n log n)."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((merged, symbols[k])):
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((symbols[h], merged))):
                heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> array:
        ids = array("I", self.merge([self.byte_id[b] for b in word.encode()]))
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def _plain(self, text: str, out: array) -> None:
        known, word = self.cache.get, self.word
        for w in self.words(text):
            out.extend(known(w) or word(w))

    def encode(self, text: str) -> array:
        """Ids of the whole text; strings of special tokens in it become their ids."""
        out, at = array("I"), 0
        if self.find_special and any(s in text for s in self.special):
            for m in self.find_special.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: array) -> str:
        """Concatenate the vocabulary's strings; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(vocabulary: str) -> Bpe:
    return Bpe(vocabulary)



def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of bigint) and the decoded text of every document.

    ``path`` is the vocabulary file on the driver; its text (a few MB, the size of a vocabulary) is broadcast.
    A null text is an empty one and has no ids. Repeated rows give repeated rows; other columns are not read.
    """
    return _mapped(docs, path, lambda i, ids, text: (i, list(ids), text), "doc_id bigint, ids array<bigint>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what bpe_encode makes, as digests that a worker takes."""

    def digest(i, ids, text):
        raw = ids if ids.itemsize == 4 else array("I", ids)
        return i, len(ids), hashlib.sha256(raw.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, path, digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str, row, schema: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for part in parts:
            out = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = codec.encode(text or "")
                out.append(row(i, ids, codec.decode(ids)))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=_arrow(schema, k)) for k, c in enumerate(columns)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, schema)


def _arrow(schema: str, k: int) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return kinds[schema.split(", ")[k].split()[1]]

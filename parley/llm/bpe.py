"""BPE encoding and decoding: a priority queue of merge ranks over a linked list of symbols.

Encoding one piece puts its symbols in a doubly linked list and every adjacent
pair that has a merge in a heap by (rank, position). The smallest entry is
merged if both its symbols are still there, skipped as stale if not; a merge
queues the two pairs it creates. Decoding looks the vocabulary strings up and
concatenates them, with one blank between, as a file without a decoder asks.

Defined cases: a null or empty text, and a text of white space, have no ids and
decode to an empty string; a null id array decodes to an empty string. The
spelling of a special token inside a text is that token. Texts are read whole.
Rows may repeat; other columns pass through, a column named like the output is
replaced. An id outside the vocabulary fails the job, and so does a file of another kind
(another normaliser, splitter or decoder than `vocabulary` reads).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.llm.shared import handed_back
from parley.llm.vocabulary import ChunkEncoder, check_supported, read_vocabulary, texts_of

# Rows of a batch that leave Python at once.
ROWS_OUT = 512
# Bits for a position in a heap entry, and for an id in a pair key.
POSITION_BITS, ID_BITS = 40, 24


class HeapBpe:
    """Ids of pieces, and strings of ids, for one vocabulary file."""

    def __init__(self, path: str):
        check_supported(path)
        vocab, merges, self.suffix, special = read_vocabulary(path)
        self.ids = vocab
        strings = {i: s for s, i in vocab.items()} | special
        self.strings = [strings.get(i) for i in range(max(strings, default=-1) + 1)]
        self.merges = {
            vocab[a] << ID_BITS | vocab[b]: (rank, vocab[a + b])
            for rank, (a, b) in enumerate(merges)
        }

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece (in byte letters) as little-endian 32 bit numbers."""
        ids, merges = self.ids, self.merges
        letters = list(piece)
        letters[-1] += self.suffix
        whole = ids.get(piece + self.suffix) if len(letters) == 1 else None
        if whole is not None:
            return whole.to_bytes(4, "little")
        symbols = [ids[x] for x in letters if x in ids]
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << ID_BITS | symbols[i + 1])
            if found:
                queue.append(found[0] << POSITION_BITS | i)
        heapify(queue)
        mask = (1 << POSITION_BITS) - 1
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << ID_BITS | symbols[j])
            if not found or found[0] != entry >> POSITION_BITS:
                continue  # stale: a neighbour was merged meanwhile
            symbols[i], symbols[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = merges.get(found[1] << ID_BITS | symbols[k])
                if right:
                    heappush(queue, right[0] << POSITION_BITS | i)
            h = before[i]
            if h >= 0:
                left = merges.get(symbols[h] << ID_BITS | found[1])
                if left:
                    heappush(queue, left[0] << POSITION_BITS | h)
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def decode(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def _vocabulary(path: str) -> HeapBpe:
    return HeapBpe(path)


@functools.lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path, _vocabulary(path).encode_piece)


def encode(text: Column, path: str) -> Column:
    """Ids of whole texts as little-endian unsigned 32 bit numbers (binary)."""

    @F.arrow_udf("binary")
    def heap_bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for batch in handed_back(batches):
            for ids in batched(encoder.encode_all(texts_of(batch)), ROWS_OUT):
                yield pa.array(ids, pa.binary())

    return heap_bpe_encode(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of ids written as `encode` writes them."""

    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _vocabulary(path)
        for batch in batches:
            for rows in batched(texts_of(batch), ROWS_OUT):
                yield pa.array([decoder.decode(x) for x in rows], pa.string())

    return bpe_decode(ids)


def round_trip(text: Column, path: str) -> Column:
    """`encode` and then `decode` of its ids, as a struct, in one pass through Python."""

    @F.arrow_udf("ids binary, decoded string")
    def heap_bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(path), _vocabulary(path)
        for batch in handed_back(batches):
            for ids in batched(encoder.encode_all(texts_of(batch)), ROWS_OUT):
                decoded = pa.array([decoder.decode(x) for x in ids], pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    return heap_bpe_round_trip(text)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")

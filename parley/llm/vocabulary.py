"""Words of a BPE vocabulary file: how texts fall into pieces, and caches of encoded pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parley.llm.shared import hand_back

# Pieces of ASCII text, as the vocabulary file's own pattern finds them (fixed value).
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
# The same for texts of ASCII and the letters of Latin-1: those compose to themselves, and each has one small letter.
LATIN_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SMALL_LATIN = [chr(x) for x in range(0xDF, 0x100) if x != 0xF7]
# What this module takes for granted of a file (fixed values): white space is dropped, so no id crosses it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Bytes of a cache's newer half, with what an entry costs beside its characters and ids: they bound
# memory and change speed, never ids. Longer pieces are not cached.
PIECE_BYTES, ENTRY_BYTES = 64_000_000, 180
CACHED_CHARS = 64
# Characters of text whose chunks are gathered at once: bounds memory, never changes ids.
SLICE_CHARS = 16_000_000
# Chunks whose ids are put together at once, one text's at least.
GATHERED_CHUNKS = 262_144


class Cache(dict):
    """A dict that computes what it lacks; when it is full, what was not used since goes."""

    def __init__(self, compute: Callable[[str], bytes], size: int):
        super().__init__()
        self.compute, self.size, self.held, self.older = compute, size, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > CACHED_CHARS:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if self.held >= self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + len(key) + len(value)
        self[key] = value
        return value


def check_supported(path: str) -> None:
    """Raise for a vocabulary file whose texts fall into pieces, or are put together, in another way."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    steps = (content.get("normalizer") or {}).get("normalizers") or []
    splits = (content.get("pre_tokenizer") or {}).get("pretokenizers") or []
    unwanted = ("byte_fallback", "ignore_merges", "continuing_subword_prefix", "dropout", "unk_token")
    same = {
        "model": model.get("type") == "BPE" and not any(model.get(name) for name in unwanted),
        "normalizer": [x.get("type") for x in steps] == NORMALIZERS,
        "pre_tokenizer": [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": PATTERN} and not splits[1]["add_prefix_space"],
        "decoder": content.get("decoder") is None,
        "added_tokens": not any(t[name] for t in content["added_tokens"] for name in ("single_word", "lstrip", "rstrip")),
    }
    other = [name for name, found in same.items() if not found]
    if other:
        raise ValueError(f"a vocabulary file of another kind: {', '.join(other)}")


class ChunkEncoder:
    """Encodes texts chunk by chunk: a chunk lies between blanks or line feeds.

    No piece of this kind of vocabulary (white space dropped, pieces split at
    it) crosses a blank, so the ids of a text are those of its chunks in order.
    Each different chunk of a slice of texts is encoded once; ids of the texts
    are then gathered from those. `encode_piece` gives the ids, as bytes, of one
    piece written in byte letters.
    """

    def __init__(self, path: str, encode_piece: Callable[[str], bytes], id_bytes: int = 4):
        from tokenizers import Tokenizer

        check_supported(path)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special = {name: i.to_bytes(id_bytes, "little") for name, i in special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.id_type = np.dtype(f"<u{id_bytes}")
        self.pieces = Cache(encode_piece, PIECE_BYTES)
        # Byte letters of the letters beyond ASCII, as the file's own steps write them.
        self.latin = {ord(x): "".join(piece for piece, _ in self.split(self.normalize(x))) for x in SMALL_LATIN}

    def encode_chunk(self, chunk: str) -> bytes:
        if self.marks is not None and "<|" in chunk:
            parts = self.marks.split(chunk)
            if len(parts) > 1:
                return b"".join(self.special.get(p) or self.encode_plain(p) for p in parts)
        return self.encode_plain(chunk)

    def encode_plain(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable():
            return b"".join(map(self.pieces.__getitem__, ASCII_PIECES.findall(chunk.lower())))
        if LATIN_TEXT.fullmatch(chunk):
            found = LATIN_PIECES.findall(chunk.lower())
            return b"".join([self.pieces[piece.translate(self.latin)] for piece in found])
        found = self.split(self.normalize(chunk))
        return b"".join([self.pieces[piece] for piece, _ in found])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self._gathered([x for _, x in _parts([text], SLICE_CHARS)]))

    def encode_all(self, texts: Iterable[str | None], slice_chars: int = SLICE_CHARS) -> Iterator[bytes]:
        """Ids of each text in turn. Every different chunk of a slice of texts is encoded once."""
        waiting, numbers, size, open_parts, done = [], [], 0, [], -1

        def flush() -> Iterator[bytes]:
            nonlocal open_parts, done
            for number, ids in zip(numbers, self._gathered(waiting), strict=True):
                if number > done >= 0:
                    yield b"".join(open_parts)
                    open_parts = []
                done = number
                open_parts.append(ids)

        for number, part in _parts(texts, slice_chars):
            waiting.append(part)
            numbers.append(number)
            size += len(part)
            if size >= slice_chars:
                yield from flush()
                waiting, numbers, size = [], [], 0
        yield from flush()
        if done >= 0:
            yield b"".join(open_parts)

    def _gathered(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each part: its chunks as numbers into the distinct ones, whose ids are put end to end."""
        plain = pc.replace_substring(pa.array(parts, pa.large_string()), "\n", " ")
        hand_back()
        split = pc.split_pattern(plain, " ")
        del plain
        coded, offsets = split.values.dictionary_encode(), split.offsets.to_numpy()
        del split
        hand_back()
        encoded = [self.encode_chunk(chunk) for chunk in texts_of(coded.dictionary)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.id_type.itemsize
        ids, firsts = np.frombuffer(b"".join(encoded), self.id_type), np.cumsum(sizes) - sizes
        chunks = coded.indices.to_numpy()
        del coded, encoded
        low = 0
        while low < len(parts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GATHERED_CHUNKS, "right")) - 1)
            chunk = chunks[offsets[low] : offsets[high]]
            counts = sizes[chunk]
            ends = np.concatenate([[0], np.cumsum(counts)])
            # The id at place t of chunk c lies at (first id of its distinct chunk) + t.
            at = np.repeat(firsts[chunk] - ends[:-1], counts)
            at += np.arange(ends[-1])
            out, bounds = ids[at], ends[offsets[low : high + 1] - offsets[low]]
            yield from [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            low = high


def _parts(texts: Iterable[str | None], most: int) -> Iterator[tuple[int, str]]:
    """Number and text of each text's parts: one, or for long texts several, cut at blanks."""
    for number, text in enumerate(texts):
        rest = text or ""
        at = 0
        while len(rest) - at > most:
            cut = rest.find(" ", at + most)
            if cut < 0:
                break
            yield number, rest[at:cut]
            at = cut + 1
        yield number, rest[at:]


def texts_of(batch: pa.Array, rows: int = 512) -> Iterator[str | None]:
    """The texts of a batch, of which only some are Python objects at once."""
    for at in range(0, len(batch), rows):
        yield from batch.slice(at, rows).to_pylist()


def read_vocabulary(path: str) -> tuple[dict[str, int], list, str, dict[int, str]]:
    """Ids of the vocabulary, merges in rank order, the word-end mark, and the special tokens."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["id"]: t["content"] for t in content["added_tokens"]}
    return model["vocab"], merges, model.get("end_of_word_suffix") or "", special

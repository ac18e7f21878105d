"""Cached encoding by public tokenizers.

Both tokenizers treat a text as a run of pieces that never interact across certain white space, so a
text is cut at such boundaries and every distinct piece is encoded by the library once per worker.
The caches are bounded; a full cache is dropped, which costs time but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .common import resident

#: Entries a worker's cache holds at most (some 200 bytes each).
CACHE_ENTRIES = 700_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class _Pieces(dict):
    """chunk -> its ids as little-endian uint32 bytes."""

    def __init__(self, encoder: WordBpe):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self.encoder.chunk_ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class WordBpe:
    """Ids of the lower-casing word BPE, equal to the library's encode(text, add_special_tokens=False).

    Its pre-tokenizer drops white space and never joins across it, so chunks between spaces, tabs and
    line breaks are independent. A chunk of Latin-1 letters (with commas, full stops or the like at
    its end) is exactly one pre-token each and goes straight to the BPE model; any other chunk goes
    through the whole library. Texts with special strings go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = _byte_alphabet()
        self.cache = _Pieces(self)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if len(chunk) > 64:
            return self._library(chunk)
        if chunk.isalpha():
            return self._word(chunk.lower()) if max(chunk) < "\u0100" else self._library(chunk)
        stem = chunk.rstrip(",.!?;:")
        if stem != chunk and stem.isalpha() and max(stem) < "\u0100":
            return self.cache[stem] + self.cache[chunk[len(stem) :]]
        return self._library(chunk)

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return self._library(text)
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.cache.__getitem__, chunks))


class PieceCounter:
    """Token counts of the sentencepiece model, equal to len(encode(text)) of the library.

    The model writes a space as a mark that no piece holds after another character (checked when the
    vocabulary is loaded), so every step from a non-space to a space is a boundary of tokens. The
    library puts one space before a text; a chunk cut before its space carries that same space.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces) and self.library.encode("a  b", out_type=str) == ["▁a", "▁", "▁b"]
        self.cache = {"": 1}  # the mark of one space at the end

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose token counts add up to the text's."""
        if not self.cuttable or "▁" in text:
            return [text] if text else []
        chunks = text.split(" ")
        if "" not in chunks:
            return chunks
        out, spaces = [], 0
        for chunk in chunks:
            if chunk:
                # n empty strings before a word: n more spaces before it
                out.append(" " * spaces + chunk)
                spaces = 0
            else:
                spaces += 1
        if spaces == len(chunks):
            return [text] if text else []
        if spaces:
            # n empty strings at the end: n spaces
            out.append(" " * (spaces - 1))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The texts' token counts; pieces that the cache lacks are encoded as one batch."""
        cut = [self.pieces(t) for t in texts]
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache = {"": 1}
        known = self.cache
        new = [p for p in set().union(*cut) if p not in known]
        met = dict(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        known.update((p, n) for p, n in met.items() if len(p) <= 64)
        met = {p: n for p, n in met.items() if len(p) > 64}
        return [sum(known[p] if len(p) <= 64 else met[p] for p in own) for own in cut]


def balanced(sizes: list[int], limit: int) -> Iterable[slice]:
    """Consecutive slices of about limit bytes each; a longer text is a slice of its own."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def loaded(kind: type, path: str):
    """One encoder per worker process and file."""
    return resident((kind, path), lambda: kind(path))

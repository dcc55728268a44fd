"""Encoding of whole texts with a public tokenizer file, memoised by word.

The tokenizer of ``word_bpe_49k.json`` drops white space and never merges
across it, so the ids of a text are the ids of its white-space separated words
in order.  :class:`WordEncoder` keeps the ids of words and of the pieces inside
words it has met; everything unusual goes to the library's full ``encode``.
``encode_all`` splits the texts of an Arrow array, cuts their words to pieces and
numbers both in Arrow, so that Python sees each distinct piece of a slice once.
"""

from __future__ import annotations

import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text whose words are numbered together; a longer text is encoded by itself.
SLICE = 16_000_000

_encoders: dict[tuple, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """text -> little-endian uint32 ids (bytes); exact for lower-casing word BPE files.

    max_entries bounds each memo (about 200 bytes an entry).  A memo is two tables:
    a full one becomes the older, from which words that still occur come back, so
    frequent words are never lost.  It costs time and never changes a result.
    """

    def __init__(self, content: str, max_entries: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_str(content)
        self.model = self.tok.model
        self.max_entries = max_entries
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        # Latin-1 letters are stable under NFC and have simple lower cases
        latin = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
        low = "".join(c for c in latin if c == c.lower())
        self.plain = re.compile(f"[!-~{latin}]+").fullmatch
        # letters, then one digit or a run of other characters: two pieces (RE2 syntax)
        self.two = rf"^(?P<letters>[A-Za-z{latin}]+)(?P<rest>[!-/:-@\[-`{{-~]*|[0-9])$"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{low}]+|[0-9]|[^a-z0-9{low}]+").findall
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {ord(c): level.pre_tokenize_str(c)[0][0] for c in low}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.older_pieces.get(piece)
            if ids is None:
                mapped = piece if piece.isascii() else piece.translate(self.byte_chars)
                found = [t.id for t in self.model.tokenize(mapped)]
                ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.pieces) >= self.max_entries // 2:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        import numpy as np

        text = word.decode("utf-8", "replace")
        if not self.plain(text) or "<|" in text:
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        return b"".join(map(self._piece, self.split(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.encode("utf-8", "replace").split()
        out = list(map(self.words.get, words))
        if None in out:
            if len(self.words) >= self.max_entries // 2:
                self.older_words, self.words = self.words, {}
            known, older = self.words, self.older_words
            for k, ids in enumerate(out):
                if ids is None:
                    w = words[k]
                    ids = known.get(w)
                    if ids is None:
                        ids = older.get(w)
                        if ids is None:
                            ids = self._word(w)
                        if len(w) <= 64:
                            known[w] = ids
                    out[k] = ids
        return b"".join(out)

    def encode_all(self, texts):
        """Yield what ``encode`` gives for each text of an Arrow string array, in order."""
        import numpy as np
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            stop = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE, side="right"))
            if stop > at:
                yield from self._encode_slice(texts.slice(at, stop - at))
            else:
                stop = at + 1
                yield self.encode(texts[at].as_py())
            at = stop

    def _encode_slice(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            yield from [b""] * len(texts)
            return
        ids = self._encode_words(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        places, ends = memoryview(offsets).cast("i"), lists.offsets.to_numpy()
        at = [places[ids.offset + k] for k in (ends - ends[0]).tolist()]
        view = memoryview(data)
        for a, b in zip(at, at[1:]):
            yield view[a:b].tobytes()

    def _encode_words(self, words):
        """The ids of distinct words, as an Arrow array of bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        def looked_up(pieces):
            coded = pieces.dictionary_encode()
            found = map(self._piece, coded.dictionary.to_numpy(zero_copy_only=False))
            return pa.array(list(found), pa.binary()).take(coded.indices)

        parts = pc.extract_regex(words, self.two)
        letters, rest = (pc.struct_field(parts, k) for k in (0, 1))
        ids = pc.binary_join_element_wise(looked_up(pc.utf8_lower(letters)), looked_up(rest), pa.scalar(b""))
        other = pc.is_null(ids)
        return pc.replace_with_mask(ids, other, pa.array([self.encode(w.as_py()) for w in words.filter(other)], pa.binary()))


def encoder(content: str) -> WordEncoder:
    """One encoder per Python worker and tokenizer, kept between its tasks."""
    key = (len(content), hash(content))
    if key not in _encoders:
        _encoders[key] = WordEncoder(content)
    return _encoders[key]

"""Token ids of whole texts by the tokenizers library, one distinct piece at a time.

Both public vocabularies split a text before any merge: no token holds a space behind another character, or a letter
together with a mark (but the apostrophe). So the ids of a text are the ids of its pieces: words with the space before
them (where the vocabulary keeps spaces), cut from the marks behind them where the letters are plain Latin ones, which
lower-case and compose alike everywhere. The library encodes each distinct piece once for a worker. Control characters
that Python and the library class differently (U+001C to U+001F) send the whole text to the library instead, and so
does an added token in the text (<|endoftext|>), which the library finds before it splits and gives its one id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

TABLE_BYTES = 32_000_000  #: memory of the pieces that a worker remembers; the table starts anew beyond that
PIECE_BYTES = 200  #: of a remembered piece beside its text and ids
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:*#$%&|"
_CLASSED_APART = re.compile("[\x1c-\x1f]")
_SPACED = re.compile(rf"\s*+[{_LETTERS}]++(?=[\s{_MARKS}]|\Z)|[{_MARKS}]++(?=\s|\Z)|\s*\S+|\s+")
_ONE_TOKEN_RUN = re.compile(rf" ?[{_LETTERS}]+")  # that the library does not split before its merges
_SPACELESS = re.compile(rf"[{_LETTERS}]++(?=[\s{_MARKS}]|\Z)|[{_MARKS}]++(?=\s|\Z)|\S+")


class PieceIds(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep_spaces: bool, most: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.most = most
        self.library, self.pieces, self.held, self.lower = Tokenizer.from_file(path), (_SPACED if keep_spaces else _SPACELESS).findall, 0, not keep_spaces
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        plain = [" ", *filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(256)))]
        self.signs = {ord(c): bytes_of(c)[0][0] for c in plain}

    def __missing__(self, piece: str) -> bytes:
        if _ONE_TOKEN_RUN.fullmatch(piece):
            plain = piece.lower() if self.lower else piece
            found = [t.id for t in self.library.model.tokenize(plain.replace(" ", self.signs[32]) if plain.isascii() else plain.translate(self.signs))]
        else:
            found = self.library.encode(piece, add_special_tokens=False).ids
        self[piece] = ids = array("I", found).tobytes()
        self.held += PIECE_BYTES + len(piece) + len(ids)
        return ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null has none."""
        for text in texts:
            text = text or ""
            if self.held > self.most:
                self.clear()
                self.held = 0
            whole = _CLASSED_APART.search(text) or any(t in text for t in self.added)
            yield b"".join(map(self.__getitem__, [text] if whole else self.pieces(text))) if text else b""


_loaded: dict[tuple[str, bool, int], PieceIds] = {}


def piece_ids(path: str, keep_spaces: bool, most: int = TABLE_BYTES) -> PieceIds:
    """The worker's table for a vocabulary file; keep_spaces: whether its tokens hold the space before a word; most: bytes
    that it remembers."""
    if (path, keep_spaces, most) not in _loaded:
        _loaded[path, keep_spaces, most] = PieceIds(path, keep_spaces, most)
    return _loaded[path, keep_spaces, most]

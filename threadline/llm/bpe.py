"""Token ids by the tokenizers library, fast on text whose words repeat.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the
string of a special token in a text becomes that token's id, so a text that holds
one goes to the library whole.  A vocabulary's pre-tokenizer never joins other
text across the places where it is cut here, so encoding the pieces and joining
their ids gives what encoding the whole text gives.  Each worker keeps the ids of
the pieces it has met in a table of bounded size.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

#: Pieces kept by a worker; once so many are kept no more are added, and later ones are encoded each time they occur.
KEPT_PIECES = 500_000
#: Pieces handed to the library at once.
PIECES_AT_ONCE = 4096


# Latin text (code points below U+0250 without rare controls): its classes never changed between Unicode versions.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_DIGIT = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0"
_LATIN = re.compile("[\t-\r -~\u0085\u00a0-\u012f\u0131-\u024f]*").fullmatch
#: A single space between two non-spaces goes with what follows; ASCII white space is white space for every vocabulary.
_AT_SPACE = re.compile(r"(?<=\S)(?= \S)").split
_BLANKS = re.compile("[^\t-\r ]+").findall
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_ATTACH = re.compile(
    f"{_SUFFIX}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
).findall
_DROP = re.compile(f"{_SUFFIX}|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+").findall


class Encoder:
    """Encodes texts with one vocabulary file.

    Latin text is cut into the words that the vocabulary's own pre-tokenizer
    makes: with ``spaces='attach'`` a space belongs to the word after it
    (byte-level vocabularies), with ``spaces='drop'`` white space makes no ids
    and the text is lower-cased.  Any other text is cut at spaces only, where no
    word can span the cut.
    """

    def __init__(self, path: str, spaces: str):
        if spaces not in ("attach", "drop"):
            raise ValueError(f"unknown treatment of spaces: {spaces}")
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(token.content) for token in added.values())).search
        self.mark_id, token = max(added.items())
        self.mark = token.content
        self.attach = spaces == "attach"
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if _LATIN(text):
            return _ATTACH(text) if self.attach else _DROP(text.lower())
        return _AT_SPACE(text) if self.attach else _BLANKS(text)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece.

        The pieces go to the library as one text in which a special token, which
        splits the text before anything else is done, stands between them.  A
        piece that could form such a token together with it goes alone.
        """
        if any("<|" in p for p in pieces):
            codes = self.library.encode_batch_fast(pieces, add_special_tokens=False)
            return {p: np.array(c.ids, "<u4").tobytes() for p, c in zip(pieces, codes)}
        code = self.library.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0]
        ids = np.array(code.ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id)
        data, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
        return {p: data[i:j] for p, i, j in zip(pieces, starts, ends)}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Every text's ids as little-endian unsigned 32-bit integers."""
        get = self.known.get
        codes, holes, new = [], [], set()
        for text in texts:
            if self.special(text):
                whole = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
                codes.append([np.array(whole, "<u4").tobytes()])
                continue
            pieces = self.cut(text)
            found = list(map(get, pieces))
            codes.append(found)
            if None in found:
                missing = [(i, pieces[i]) for i, code in enumerate(found) if code is None]
                new.update(p for _, p in missing)
                holes.append((found, missing))
        ids: dict[str, bytes] = {}
        unseen = list(new)
        for a in range(0, len(unseen), PIECES_AT_ONCE):
            ids.update(self._encode_pieces(unseen[a : a + PIECES_AT_ONCE]))
        for found, missing in holes:
            for i, piece in missing:
                found[i] = ids[piece]
        if len(self.known) + len(ids) <= KEPT_PIECES:
            self.known.update(ids)
        return list(map(b"".join, codes))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]

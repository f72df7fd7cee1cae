"""Encode texts with a public tokenizer, remembering the ids of recent words."""

from __future__ import annotations

import os
import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer

# White space beyond blank, tab, newline and carriage return.
ODD_SPACE = r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONGEST = 64

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which may belong to the next token
WORD_PIECE = rf"[{LETTERS}]+(?=[{MARKS} \t\n\r]|\Z)"
SPACED = re.compile(rf"\n(?=[^ \t\n\r])|[ \t\n\r]*{WORD_PIECE}|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
UNSPACED = re.compile(rf"{WORD_PIECE}|[^ \t\n\r]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for those from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)}


class WordEncoder:
    """Ids of whole texts, as the tokenizer gives them, in little-endian unsigned 32-bit integers.

    Both vocabularies end a token where white space follows other characters and where punctuation follows a word, so a text
    can be encoded piece by piece and the ids of a piece remembered. ``keeps_space``: the white space before a word belongs to
    its tokens (byte-level vocabularies); otherwise it is dropped, and letters are lowered. A text with rarer white space is
    encoded in one go where space counts. A text that contains a special string of the vocabulary is encoded in one go too, and gets
    its id as the plain tokenizer gives it; with ``escape`` such strings are letters like others. At most ``room`` pieces are remembered, so memory is bounded.
    """

    def __init__(self, name: str, keeps_space: bool, room: int = 600_000, escape: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = escape
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case of letters: a piece is lowered, a special string is not
        self.special = re.compile("|".join(special), re.IGNORECASE) if special and not escape else None
        self.odd = re.compile(ODD_SPACE) if keeps_space else None
        self.find = (SPACED if keeps_space else UNSPACED).findall
        self.word = re.compile(rf" ?[{LETTERS}]+" if keeps_space else rf"[{LETTERS}]+").fullmatch
        self.model = self.tokenizer.model
        self.alphabet = byte_letters()
        self.room = room
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.odd is None:
            text = text.lower() if text.isascii() else text
        elif self.odd.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self.find(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        new = [x for x in set(pieces) if x not in known]
        long = [x for x in new if len(x) > LONGEST]
        others = []
        for piece in new:
            if self.word(piece):  # one word: only the model's merges are left to do
                letters = (piece if self.odd else piece.lower()).encode("utf-8").decode("latin-1").translate(self.alphabet)
                known[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                others.append(piece)
        for piece, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[piece] = array("I", found.ids).tobytes()
        out = b"".join(map(known.__getitem__, pieces))
        for piece in long:
            del known[piece]
        if len(known) > self.room:
            known.clear()
        return out

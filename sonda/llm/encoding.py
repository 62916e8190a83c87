"""Token ids of whole texts by the tokenizers library, with what it gives for words kept in bounded tables.

Byte-level tokenizers that split by the usual pattern, and lower-casing ones that drop white space, treat the
pieces between single blanks alone, so ids are kept by piece and, for new pieces, by word. Texts with characters
outside Latin letters and common marks, or with blanks in a row, go through the library as wholes.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from .transducer import byte_of_stand_in

#: Characters for which Python and the library agree on letters, digits, white space and lower case.
_ODD = r"[^\n\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞€]"
#: Those of them in Latin-1, as bytes.
PLAIN = bytes([10, *range(0x20, 0x7F), *range(0xA1, 0x100)])
PIECES, WORDS = 400_000, 100_000
ENDS = tuple(".,;:!?")


class _Kept(dict):
    """What ``make`` gives for a key; begun anew when it holds ``most``."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """``ids(text)``: the bytes of the little-endian ids of a text, without special tokens around it."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.code = {1: "B", 2: "H", 4: "I"}[self.dtype.itemsize]
        if max(spec["model"]["vocab"].values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} don't fit {dtype}")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.form, self.common = "whole", re.compile(_ODD)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.form = "byte"
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        elif pre.get("type") == "Sequence" and norm and norm.get("type") == "Sequence":
            kinds, split = [n["type"] for n in norm["normalizers"]], pre["pretokenizers"][0]
            if kinds == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]:
                self.form = "word"
                self.pattern = regex.compile(split["pattern"]["Regex"])
        self.tokenize, self.stand_ins = self.library.model.tokenize, {b: c for c, b in byte_of_stand_in().items()}
        self.words = _Kept(self._word, WORDS)
        self.pieces = _Kept(self._piece, PIECES)
        #: Pieces that begin a line, so without a blank before them.
        self.firsts = _Kept(lambda x: self._word(x) if x.isalpha() else self._library(x), WORDS)
        self.newline = self._library("\n") if self.form == "byte" else b""

    def _bytes(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """One pre-token through the library's model, with its bytes as the vocabulary writes them."""
        return self._bytes([t.id for t in self.tokenize(word.encode("utf-8").decode("latin-1").translate(self.stand_ins))])

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == "\0":
            return self.newline + (self.firsts[piece[1:]] if len(piece) > 1 else b"")
        if piece[-1:] in ENDS and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        if self.form == "word":
            if piece.isalpha():
                return self._word(piece.lower())
            if any(s in piece for s in self.special):
                return self._library(piece)
            return b"".join([self.pieces[w] if w.isalpha() else self.words[w] for w in self.pattern.findall(piece.lower())])
        if piece.isalpha():
            return self._word(" " + piece)
        text = " " + piece
        if any(s in text for s in self.special):
            return self._library(text)
        return b"".join([self.pieces[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in self.pattern.findall(text)])

    def _simple(self, text: str) -> bool:
        """Whether blanks part the text into pieces that stand alone."""
        try:
            plain = not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            plain = self.common.search(text) is None
        return plain and (self.form == "word" or not ("  " in text or " \n" in text or "\n " in text))

    def ids(self, text: str) -> bytes:
        if self.form == "whole" or not self._simple(text):
            return self._library(text)
        if self.form == "word":
            return b"".join(map(self.pieces.__getitem__, text.split()))
        if "\n" in text and "\n\n" not in text:
            text = text.replace("\n", " \0")  # a piece after a single newline stands alone too, without a blank
        first, *rest = text.split(" ")
        head = self.firsts[first] if first else b""
        return head + b"".join(map(self.pieces.__getitem__, rest)) if rest else head

"""Token ids of whole texts from the tokenizers library, each different word encoded once a process.

A text is cut only where the tokenizer itself always starts a new piece:
before ASCII white space that follows a character that is not white space. A
part is that white space with the word after it; neither vocabulary's rules
read past such a part, so its ids do not depend on the text around it (tests
hold that against encoding whole texts). Texts with other white space, with
controls or with combining marks after white space are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Words remembered in all, about 80 MB: a third of them for good, and two generations of the others.
MOST = 600_000
PART = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: What no part can be cut by: white space other than ASCII's, controls, marks after white space.
ODD_SET = "\x00-\x08\x0e-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿"
ODD = re.compile(f"[{ODD_SET}]|[ \t\n\r\x0b\x0c][̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
#: Texts without a match, and without two of space and newline in a row or one at the end, have one between words.
MIXED = re.compile(f"[{ODD_SET}\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\t\r\x0b\x0c]")
#: Parts of which lower case and piece rules are the same in every library.
CLOSING = frozenset(".,;:!?")
PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = {b: chr(b) for b in own}
    for i, b in enumerate(x for x in range(256) if x not in own):
        out[b] = chr(256 + i)
    return out


class _Known(dict):
    """Parts and their ids; one that is missing is taken from the generation before, or else learned.

    Parts met in two generations are kept for good, up to ``often`` of them;
    the others go with the second generation after theirs.
    """

    def __init__(self, learn, often: int):
        self.learn, self.often, self.before, self.kept = learn, often, {}, {}

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            found = self.learn(part)
        elif len(self.kept) < self.often:
            self.kept[part] = found
        self[part] = found
        return found

    def turn(self, most: int) -> None:
        """Begin a new generation if this one has met most parts of its own."""
        if len(self) - len(self.kept) > most:
            self.before = dict(self)
            self.clear()
            self.update(self.kept)


class WordCache:
    """ids(texts) gives the ids of each text as little-endian unsigned integers of ``width`` bytes; null is like empty.

    Ids are those of the library's defaults: where a text holds the content of
    a special token, that is its id, and the text is cut there.
    """

    def __init__(self, path: str, most: int = MOST):
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if n <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.packed = [i.to_bytes(self.width, "little") for i in range(n)]
        with open(path) as f:
            rules = json.load(f)
        pre = rules["pre_tokenizer"]
        kind = [x["type"] for x in pre.get("pretokenizers", [pre])]
        self.pieces, self.lower = None, bool(rules["normalizer"])
        if kind == ["ByteLevel"] and not rules["normalizer"]:
            self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        elif kind == ["Split", "ByteLevel"] and rules["normalizer"]:
            self.pieces = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        added = rules["added_tokens"]
        #: Special tokens that are found in the raw text as they stand; with others, texts are encoded whole.
        self.special = {x["content"]: self.packed[x["id"]] for x in added}
        self.plain = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        #: Words after a space, without it, and parts taken as they stand.
        self.words, self.parts = _Known(self._word, most // 3), _Known(self._part, most // 12)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _pieces(self, pieces: list[str]) -> bytes:
        """Ids of pieces through the library's model, spaces and other bytes in the byte-level alphabet."""
        out = []
        for p in pieces:
            if not p.isascii() or not p.isprintable():
                p = p.encode().decode("latin-1").translate(self.letters)
            elif p[0] == " ":
                p = p.replace(" ", "\u0120")
            out += [self.packed[t.id] for t in self.tokenize(p)]
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space; a line's first word begins with the newline instead."""
        if word.isascii() and self.pieces:
            if self.lower:
                word = word.lower()
            if word.isalpha():
                return b"".join([self.packed[t.id] for t in self.tokenize(word if self.lower else "\u0120" + word)])
            if word[-1:] in CLOSING and word[:-1].isalpha():  # one piece, and one of its closing mark
                return b"".join([self.packed[t.id] for p in (word[:-1] if self.lower else "\u0120" + word[:-1], word[-1]) for t in self.tokenize(p)])
        return self._part(word if word[:1] == "\n" else " " + word)

    def _part(self, part: str) -> bytes:
        if self.pieces is None or not (part.isascii() or PLAIN.fullmatch(part)):
            return self._encode(part)
        return self._pieces(self.pieces(part.lower() if self.lower else part))

    def _text(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        self.words.turn(self.most // 3)
        self.parts.turn(self.most // 12)
        if not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n" or MIXED.search(text)):
            head, *parts = text.replace("\n", " \n").split(" ")
            return self.parts[head] + b"".join(map(self.words.__getitem__, parts))
        if ODD.search(text):
            return self._encode(text)
        return b"".join(map(self.parts.__getitem__, PART.findall(text)))

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            text = text or ""
            if not self.plain:
                out.append(self._encode(text))
            elif any(x in text for x in self.special):
                out.append(b"".join(self.special[x] if k % 2 else self._text(x) for k, x in enumerate(self.cut.split(text))))
            else:
                out.append(self._text(text))
        return out


@lru_cache(maxsize=4)
def shared(path: str) -> WordCache:
    """The process's own cache of a vocabulary, kept from task to task."""
    return WordCache(path)

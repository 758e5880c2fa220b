"""Encoding with the public tokenizers, with caches of what earlier words encoded to.

Both vocabularies cut a text at white space before any merge, so the ids of a
text are the ids of its words one after the other. A word's ids are taken from a
bounded cache; a missing word goes through the library's own model, cut into
pieces as its file prescribes. Texts in which the cut could differ (special
token strings, unusual white space or controls) and words with characters beyond
the plain Latin letters are encoded by the library as a whole. So are all texts if
the file normalises or cuts in another way than KNOWN_RULES say, or adds other tokens.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: Words after which a worker's cache drops those it did not meet again; it holds twice as many at most.
CACHE_WORDS = 350_000
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: White space and controls other than blanks and line feeds.
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile(f"[\\n\\x20-\\x7e{_LETTER}]*")

# The normaliser, the cutting and the model settings, by leading space, that the rules of this module are made for.
KNOWN_RULES = {
    True: {
        "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    },
    False: {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    },
}


def follows_known_rules(tokenizer, lead_space: bool) -> bool:  # noqa: ANN001
    """Whether words may be encoded one by one: the file cuts as KNOWN_RULES say, and its added tokens all hold `<|`."""
    given, want = json.loads(tokenizer.to_str()), KNOWN_RULES[lead_space]
    model = {k: v for k, v in given["model"].items() if k not in ("vocab", "merges")}
    same = all(given.get(k) == want[k] for k in ("normalizer", "pre_tokenizer")) and model == want["model"]
    return same and not given.get("truncation") and not given.get("padding") and all("<|" in t["content"] for t in given.get("added_tokens") or ())


def _byte_chars() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """Remembers what make() gave; when full, only keys that are met again outlive the next filling."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TokenEncoder:
    """encode(text) gives the ids of a text as little-endian unsigned 32-bit integers.

    path: a file of the tokenizers library, either of byte-level pieces with a
    leading space (lead_space=True) or of lower-case pieces with word ends.
    """

    def __init__(self, path: str, lead_space: bool, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lead_space, self.by_words = lead_space, follows_known_rules(self.tokenizer, lead_space)
        self.shown = _byte_chars()
        self.pieces = _Cache(self._piece, cache_words)
        self.words = _Cache((lambda w: self._word(w if w[:1] == "\n" else " " + w)) if lead_space else self._word, cache_words)
        tail = "re|ve|m|ll|d"
        if lead_space:
            self.cut = re.compile(f"'(?:s|t|{tail})| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+")
            self.odd = re.compile(r"\s |\s$| \s|^\s|<\||[\x1c-\x1f\x85]")
        else:
            self.cut = re.compile(f"'(?:s|t|{tail})|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
            self.odd = re.compile(r"<\||[\x1c-\x1f]")

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        shown = "".join(map(self.shown.__getitem__, piece.encode()))
        return _packed([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if self.lead_space and word[:1] == "\n":
            return self.pieces["\n"] + self._word(word[1:])
        core = word.rstrip(".,")
        letters = core[1:] if self.lead_space and core[:1] == " " else core
        if letters.isascii() and letters.isalpha():  # one piece, and perhaps one of punctuation
            shown = letters.lower() if not self.lead_space else core.replace(" ", self.shown[32])
            out = _packed([t.id for t in self.model.tokenize(shown)])
            return out + self.pieces[word[len(core) :]] if len(core) < len(word) else out
        if not _PLAIN.fullmatch(word):
            return self._whole(word)
        pieces = self.cut.findall(word if self.lead_space else word.lower())
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _is_odd(self, text: str) -> bool:
        """Whether odd matches; plain substring tests decide most texts."""
        if "<|" in text:
            return True
        if self.lead_space and ("  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()):
            return True
        return _RARE.search(text) is not None and self.odd.search(text) is not None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words or self._is_odd(text):
            return self._whole(text)
        if not self.lead_space:
            return b"".join(map(self.words.__getitem__, text.split()))
        if "\n" in text and "\n\n\n" not in text and _RARE.search(text) is None:
            # each of one or two line feeds before a word is a piece of its own, so words are cut there too
            text = text.replace("\n", " \n")
        first, *rest = text.split(" ")
        return self._word(first) + b"".join(map(self.words.__getitem__, rest))


_made: dict[tuple, TokenEncoder] = {}


def encoder(path: str, lead_space: bool, cache_words: int = CACHE_WORDS) -> TokenEncoder:
    """The encoder of this Python worker, made once."""
    key = (path, lead_space, cache_words)
    if key not in _made:
        _made[key] = TokenEncoder(path, lead_space, cache_words)
    return _made[key]

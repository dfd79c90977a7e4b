"""Encoders over the tokenizer libraries that work on safe units of a text.

A byte-level pre-tokenizer never matches a non-space character followed by white space, so a text may be cut
before any blank or line feed that follows a non-space character: every piece is then encoded on its own with
the same ids as the whole. Units recur, so each worker keeps their ids in a bounded cache.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

#: White space by any of the libraries' definitions; a cut never follows one of these.
_WIDE_SPACE = r"\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
_SAFE_CUT = re.compile(f"(?<=[^{_WIDE_SPACE}])(?=[ \n])")
#: What may stand before or be a blank that is no plain one; a text with any of these is cut by the pattern.
_ODD_SPACES = "\x01\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Letters of the first Unicode blocks, on whose class all regex libraries agree.
_PLAIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

#: Units of printable ASCII, and their byte-level pre-tokens.
_PLAIN_UNIT = re.compile("[\n ]?[!-~]+")
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|\n")

#: A comma or full stop at the end of a word that doesn't follow a letter. One that does is a pre-token of its own.
_ODD_STOP = re.compile("[,.](?<![A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][,.])(?=[ \n]|\\Z)")


def _plain_spaces(text: str) -> bool:
    """Whether all white space of a text is single blanks and line feeds."""
    return not ("  " in text or " \n" in text or "\n\n" in text or "\n " in text or any(c in text for c in _ODD_SPACES))


def safe_units(text: str) -> list[str]:
    """Cut before each blank or line feed that follows a non-space character; the units join to the text."""
    if _plain_spaces(text) and "\x00" not in text:
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")
    return _SAFE_CUT.split(text)


def counted_units(text: str) -> tuple[list[str], list[str]]:
    """The same units in two lists: those that begin with a blank, without it, and the others; in no order."""
    if not _plain_spaces(text):
        units = _SAFE_CUT.split(text)
        return [x[1:] for x in units if x[:1] == " "], [x for x in units if x and x[0] != " "]
    after_blank, others, lead = [], [], ""
    for line in text.split("\n"):
        words = line.split(" ")
        others.append(lead + words[0])
        del words[0]
        after_blank += words
        lead = "\n"
    return after_blank, [x for x in others if x]


def safe_pieces(text: str, size: int = 1 << 15) -> list[str]:
    """Cut a long text at the first safe place after every ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE_CUT.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    table = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class _Units(dict):
    """Ids of each unit as little-endian 32-bit bytes. When full, what was used since the last time is kept apart."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.before = encode, limit, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        out = self.before.get(unit)
        if out is None:
            out = self.encode(unit)
        self[unit] = out
        return out


class JsonEncoder:
    """A tokenizers file. Byte-level ones without a normalizer are encoded by units, others as whole texts."""

    def __init__(self, content: bytes, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.by_units = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        if any(" " in x or "\n" in x for x in self.added) or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            self.by_units = False
        self.model = self.tokenizer.model
        self.alphabet, self.blank = str.maketrans(dict(enumerate(byte_alphabet()))), byte_alphabet()[32]
        # Keys lack the blank that the unit begins with; units without one have a cache of their own.
        self.after_blank = _Units(self._after_blank, cache)
        self.others = _Units(self._unit, cache // 8)
        self.pre_tokens, self.feed = _Units(self._pre_token, cache // 8), byte_alphabet()[10]
        self.comma, self.stop = self._whole(","), self._whole(".")
        if any(_PLAIN_WORD.fullmatch(x.strip()) or set(x) & set(",.") for x in self.added):
            self.by_units = False

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pre_token(self, text: str) -> bytes:
        """A pre-token of printable ASCII, with or without a blank before it, or a line feed goes to the model itself."""
        return array("I", [x.id for x in self.model.tokenize(text.replace(" ", self.blank).replace("\n", self.feed))]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """A unit of printable ASCII is cut into its pre-tokens here, others by the library."""
        if self.by_units and _PLAIN_UNIT.fullmatch(unit) and not self.added_in(unit):
            return b"".join([self.pre_tokens[x] for x in _PRE_TOKENS.findall(unit)])
        return self._whole(unit)

    def plain(self, word: str) -> str | None:
        """A blank and a word of plain letters in the byte alphabet, which is one pre-token; None for other words."""
        if not (word.isalpha() and (word.isascii() or _PLAIN_WORD.fullmatch(word))):
            return None
        return self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))

    def _after_blank(self, word: str) -> bytes:
        """One pre-token of plain letters goes to the model itself, a comma or full stop after it is one more.

        A word that begins with \\x01 is a comma or full stop that was cut off before.
        """
        if word in ("\x01,", "\x01."):
            return self.comma if word[1] == "," else self.stop
        if plain := self.plain(word):
            return array("I", [x.id for x in self.model.tokenize(plain)]).tobytes()
        last = word[-1:]
        if last in (",", ".") and word[:-1].isalpha() and _PLAIN_WORD.fullmatch(word, 0, len(word) - 1):
            return self.after_blank[word[:-1]] + (self.comma if last == "," else self.stop)
        return self._unit(" " + word)

    def added_in(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def __call__(self, text: str) -> bytes:
        if not self.by_units:
            return self._whole(text)
        after_blank, others, out = self.after_blank, self.others, []
        if not _plain_spaces(text):
            return b"".join([after_blank[x[1:]] if x[0] == " " and x[1:2] != "\x01" else others[x] for x in safe_units(text)]) if text else b""
        if not _ODD_STOP.search(text):
            for stop in ",.":
                text = text.replace(stop + " ", f" \x01{stop} ").replace(stop + "\n", f" \x01{stop}\n")
            if text[-1:] in (",", "."):
                text = f"{text[:-1]} \x01{text[-1]}"
        lead = ""
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(others[lead + words[0]])
            out += [after_blank[x] for x in words[1:]]
            lead = "\n"
        return b"".join(out)


#: White space as the split patterns have it, and alternatives of a pattern that match nothing else.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SPACE_RULES = {r"\s+(?!\S)", r"\s+", r"\s", r"\s++$", r"\s+$"}
#: Characters that are handed to the library at once, where a text can be cut; longer runs of white space are no match for it.
_AT_ONCE = 1 << 16


class RankEncoder:
    """tiktoken with a local rank file and the given split pattern; no special tokens.

    Longer texts are cut at safe places. In a run of white space there is none, and the library's pattern matcher runs
    out of stack on a very long one. Where the pattern has the rule that a run leaves its last character to what
    follows, such a run is cut there and its first part, one match of the pattern, is encoded as one piece.
    """

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        rules = [x for x in pattern.split("|") if re.search(r"(?<!\[\^)\\s|\\[rnt]", x)]
        self.leaves_last = r"\s+(?!\S)" in rules and set(rules) <= _SPACE_RULES
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            self.table[k] = piece

    def __call__(self, text: str) -> list[int]:
        if len(text) <= _AT_ONCE:
            return self.encoding.encode_ordinary(text)
        return [k for piece in safe_pieces(text) for k in self._piece(piece)]

    def _piece(self, text: str) -> list[int]:
        encode, out, at = self.encoding.encode_ordinary, [], 0
        if len(text) > _AT_ONCE and self.leaves_last:
            for run in _SPACES.finditer(text):
                if run.end() - run.start() > _AT_ONCE // 16:
                    end = run.end() - (run.end() < len(text))
                    out += encode(text[at : run.start()])
                    out += self.encoding._encode_single_piece(text[run.start() : end])
                    at = end
        return out + encode(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


class PieceEncoder:
    """A sentencepiece file; whole texts."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)

    def __call__(self, text: str) -> bytes:
        return array("I", self.processor.encode(text)).tobytes()


_OPEN: dict = {}


def opened(kind: type, *args):
    """One encoder for each file in a Python worker, which serves many tasks."""
    key = (kind, args)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = kind(*args)
    return _OPEN[key]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file, read once by the driver and sent along; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()

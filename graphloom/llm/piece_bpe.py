"""Merge-type sentencepiece encoding by backtracking, and decoding (operator 11).

A merge-type encoding joins the adjacent pair with the best score until no two adjacent symbols form a piece. A list of
pieces is the encoding of a text if and only if each two adjacent ones are compatible: the merges of their joint text
end in just these two. (Take the first merge that crosses a border: up to it, the merges on either side are those of the
two pieces alone, so it would cross there as well.) So the encoding is found from left to right: at each place the
longest piece that begins there (Aho-Corasick), then its shorter prefixes, until one is compatible with the piece before. The
encoding of every prefix of a text is unique, so a place from which no piece goes on is never tried again; a bitfield
holds these places, and every place is passed once.

Texts are cut into units first, where no piece of the vocabulary can cross: before a blank that follows something else,
and around characters that stand in no piece of two characters or more. Units recur, so workers remember their ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, whole_text
from .encoders import opened, read_vocabulary

BLANK = "▁"
#: Units that a worker remembers, characters of a unit that is remembered, and pairs of pieces whose check is.
UNITS, UNIT_CHARS, PAIRS = 400_000, 64, 2_000_000


class _Known(dict):
    """Ids of units and the same in decimal, joined by commas. When full, what was used since the last time is kept apart."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead, self.before = encode, lead, {}

    def __missing__(self, unit: str) -> tuple[tuple[int, ...], str]:
        found = self.before.get(unit)
        if found is None:
            ids = tuple(self.encode(self.lead + unit))
            found = (ids, ",".join(map(str, ids)))
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.before = dict(self)
                self.clear()
            self[unit] = found
        return found


class MergeEncoder:
    """A merge-type sentencepiece model with byte fallback.

    Models that rewrite characters are normalised by the library's own normaliser first. Other kinds of models, and
    pieces that users defined, raise ValueError.
    """

    def __init__(self, content: bytes):
        import ahocorasick
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.ids, self.scores, self.bytes = {}, {}, [None] * 256
        for k in range(p.get_piece_size()):
            piece = p.id_to_piece(k)
            if p.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (p.is_control(k) or p.is_unknown(k)):
                if p.is_unused(k):
                    raise ValueError("models with unused pieces are not supported")
                self.ids[piece], self.scores[piece] = k, p.get_score(k)
        if None in self.bytes:
            raise ValueError("models without byte fallback are not supported")
        multi = [x for x in self.ids if len(x) > 1]
        self.joined = {c for x in multi for c in x}
        if not self.joined <= self.ids.keys():
            raise ValueError("models with pieces of characters that are no pieces are not supported")
        self.cut_blanks = all(BLANK not in x.lstrip(BLANK) for x in multi)
        self.cut_lines = "\n" not in self.joined
        self.plain = p.normalize(" a\n  b \tÄÅﬁ") == BLANK + BLANK + "a\n" + BLANK * 2 + "b" + BLANK + "\tÄÅﬁ"
        # The automaton walks from a place as far as pieces go on; the longest piece that ends on this way is the match.
        self.automaton, self.match = ahocorasick.Automaton(), {}
        for x in sorted(self.ids, key=len):
            self.automaton.add_word(x, len(x))
            for n in range(1, len(x)):
                self.match.setdefault(x[:n], self.match.get(x[: n - 1], ""))
            self.match[x] = x
        for x in sorted(self.match, key=len):
            if x not in self.ids:
                self.match[x] = self.match.get(x[:-1], "")
        self.widest = max(map(len, self.ids))
        #: Two characters that stand side by side in no piece: a border that no merge crosses.
        self.inside = {x[k : k + 2] for x in multi for k in range(len(x) - 1)}
        #: The longest piece that is a proper prefix of a piece.
        self.shorter = {x: self.match.get(x[:-1]) or None for x in self.ids}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.after_blank, self.others = _Known(self._unit, BLANK), _Known(self._unit, "")
        for sample in ("the merges of this model", BLANK * 5, "aaaaabababb 1234"):
            if self.encode(sample) != p.encode(sample):
                raise ValueError("not a merge-type model")

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text by the merges themselves: best score first, then the leftmost."""
        parts, nxt = list(text), [*range(1, len(text)), -1]
        prev, heap = [*range(-1, len(text) - 1)], []

        def offer(a: int):
            if a >= 0 and (b := nxt[a]) >= 0 and (both := parts[a] + parts[b]) in self.scores:
                heappush(heap, (-self.scores[both], a, both))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, both = heappop(heap)
            if parts[a] and (b := nxt[a]) >= 0 and parts[a] + parts[b] == both:
                parts[a], parts[b] = both, ""
                nxt[a] = nxt[b]
                if nxt[b] >= 0:
                    prev[nxt[b]] = a
                offer(prev[a])
                offer(a)
        return [x for x in parts if x]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two pieces ends in these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self._merge(left + right) == [left, right]
        return found

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces themselves."""
        size, widest, pairs, match, shorter, walk = len(text), self.widest, self.pairs, self.match, self.shorter, self.automaton.longest_prefix
        failed, out, at, last = bytearray(size // 8 + 1), [], 0, ""
        piece: str | None = match[text[: walk(text[:widest])]]
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = not last or pairs.get((last, piece))
                    if fits is None:
                        fits = self.compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                if end == size:
                    return out
                at, last = end, piece
                window = text[at : at + widest]
                piece = match[window[: walk(window)]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                piece = shorter[piece]

    def _unit(self, unit: str) -> list[int]:
        """Ids of a unit: stretches of joinable characters by backtracking, the others by themselves or as bytes.

        A last character that no piece joins to the one before, such as a comma, is taken off, as the rest may be known.
        """
        if self.joined.issuperset(unit):
            if len(unit) > 2 and unit[-2:] not in self.inside:
                rest = self.after_blank[unit[1:-1]] if unit[0] == BLANK else self.others[unit[:-1]]
                return [*rest[0], self.ids[unit[-1]]]
            return [self.ids[x] for x in self._pieces(unit)]
        out, start = [], 0
        for k, c in enumerate(unit):
            if c not in self.joined:
                if start < k:
                    out += [self.ids[x] for x in self._pieces(unit[start:k])]
                out += [self.ids[c]] if c in self.ids else [self.bytes[b] for b in c.encode()]
                start = k + 1
        if start < len(unit):
            out += [self.ids[x] for x in self._pieces(unit[start:])]
        return out

    def units(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids of each unit of a text, and the same in decimal joined by commas."""
        if not text:
            return []
        if not self.plain:
            text = self.processor.normalize(text).replace(BLANK, " ")
        else:
            text = " " + text.replace(BLANK, " ")
        after_blank, others, out = self.after_blank, self.others, []
        if not self.cut_blanks:
            return [others[text.replace(" ", BLANK)]]
        for k, line in enumerate(text.split("\n") if self.cut_lines else (text,)):
            if k:
                out.append(others["\n"])
            if "  " in line or line[-1:] == " ":
                units = re.findall(" +[^ ]*|[^ ]+", line)
                out += [after_blank[x[1:].replace(" ", BLANK)] if x[0] == " " else others[x] for x in units]
                continue
            words = line.split(" ")
            if words[0]:
                out.append(others[words[0]])
            del words[0]
            out += [after_blank[x] for x in words]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([x[0] for x in self.units(text)]))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """Encode every row of ``docs(doc_id, text)`` and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in
    UTF-8) and with ``keep_ids`` also ids (array) and decoded. No begin or end ids. Null texts count as empty: no
    tokens, and the digests of no bytes. Every row, repeated or not, gives one row, an empty table none; doc_id may be
    null; columns besides these two are left out, whatever their names. Very long texts are encoded whole, in time
    that grows with their length.
    """
    limit_batches(docs.sparkSession)
    content = read_vocabulary(model)
    extra = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(MergeEncoder, content)
        for batch in batches:
            out = [[] for _ in schema]
            for text in batch.column(1).to_pylist():
                units = encoder.units(text)
                ids, joined = list(chain.from_iterable([x[0] for x in units])), ",".join([x[1] for x in units])
                decoded = encoder.decode(ids)
                for column, value in zip(out[1:], (len(ids), sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest(), ids, decoded)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, type=f.type) for v, f in zip(out[1:], list(schema)[1:]))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of each row of ``encoded(doc_id, ids)`` by the library: doc_id, decoded. Null ids give an empty text."""
    limit_batches(encoded.sparkSession)
    content = read_vocabulary(model)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(MergeEncoder, content)
        for batch in batches:
            decoded = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, type=pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")

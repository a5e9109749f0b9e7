"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of symbol pairs in order of score.

All adjacent pairs of symbols that are pieces wait in a heap, best score first, then leftmost; the best is merged
and the pairs it makes are pushed, until none is left. Symbols outside the vocabulary fall back to bytes. No piece
of such a vocabulary has a space mark behind another character (which is checked when it is loaded), so merges
never cross the start of a word, nor go from a character to a sign that no piece has behind it: words and signs are
encoded one by one and remembered, a bounded number of bounded length.

Batch by batch, the ids are checked against the sentencepiece library: every part that a task meets for the first
time by itself, and as a whole every text with a seam (the characters on both sides of a cut) that the task has not
met yet. What a text adds to its parts are its seams, so a text all of whose parts and seams are known to be right
is right. A text with a part or a seam that was found wrong gets the library's ids, and ``agrees`` says so. Decoding
is the library's.

Nulls: a null text is an empty one (begin and end ids alone). Repeated rows and null ids keep their rows. An empty
table gives an empty result. Texts are encoded whole; long ones cost time in proportion. Of other columns only those
that are asked for stay; one that has a result column's name gives way to it.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_arrow, whole_text

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: As _WORD, but signs that follow a word, and line ends, are parts of their own.
_SIGNS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")
_PART = re.compile(f"{MARK}*[{_SIGNS}]*[^{MARK}\n{_SIGNS}]+|{MARK}*[{_SIGNS}]+|{MARK}+|\n+")
#: Parts that a task remembers at most (it forgets all when full), and code points of one that is remembered.
REMEMBERED, SHORT = 300_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Agenda:
    """The encoder of one model file."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in usual}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        many = [p for p in ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in many):
            raise ValueError("this vocabulary has pieces that go on over the start of a word")
        self.n = sp.get_piece_size()
        self.ids = dict(ids)
        for c in sorted(set("".join(many)) - set(ids)):  # characters that only stand in longer pieces
            self.ids[c] = self.n + len(self.ids)
        rank = {s: r for r, s in enumerate(sorted({-sp.get_score(ids[p]) for p in many}))}
        self.merges = {
            self.ids[p[:k]] << 20 | self.ids[p[k:]]: (rank[-sp.get_score(ids[p])] << 40, ids[p]) for p in many for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        }
        # Where may a text be cut before a sign or a line end? Where no piece has it behind the character before.
        sign = re.compile(f"[{_SIGNS}]")
        before = {a for p in many for a, b in zip(p, p[1:], strict=False) if sign.match(b) and not sign.match(a) and a != MARK}
        self.unsafe = re.compile("[" + re.escape("".join(sorted(before))) + "]") if before else None
        self.by_parts = not any("\n" in p for p in many) and "\n" not in ids
        self.begin, self.end = (pack([i]) for i in (sp.bos_id(), sp.eos_id()))
        self.known = _Known(self)
        self.fresh: list[str] = []  # parts that are not checked yet
        self.wrong: set[str] = set()
        self.seams: set[str] = set()  # those that are right

    def word_ids(self, word: str) -> list[int]:
        """The ids of ``word``: all adjacent pairs that make a piece wait by (score, place); the best is merged until none is left."""
        get, merges = self.ids.get, self.merges
        symbol = [get(c, -1) for c in word]
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            m = merges.get(symbol[i] << 20 | symbol[i + 1])
            if m is not None:
                agenda.append(m[0] | i)
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or symbol[i] == -2:
                continue
            m = merges.get(symbol[i] << 20 | symbol[j])
            if m is None or m[0] != top - i:
                continue  # one of the two has been merged meanwhile
            s = symbol[i] = m[1]
            symbol[j] = -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(s << 20 | symbol[k])
                if m is not None:
                    heapq.heappush(agenda, m[0] | i)
            h = before[i]
            if h >= 0:
                m = merges.get(symbol[h] << 20 | s)
                if m is not None:
                    heapq.heappush(agenda, m[0] | h)
        out: list[int] = []
        i = 0
        while i < n:
            s = symbol[i]
            if 0 <= s < self.n:
                out.append(s)
            else:
                out.extend(self.bytes[b] for b in word[i].encode())
            i = after[i]
        return out

    def parts(self, text: str) -> list[str]:
        """What the text is encoded by: no merge goes from one part to the next."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return (_PART if self.by_parts and not (self.unsafe and self.unsafe.search(marked)) else _WORD).findall(marked)

    def _check_parts(self) -> None:
        """Compares new parts with the library. It puts a mark before a text; where the part has none, a line end, which merges with nothing, stands between."""
        for k in range(0, len(self.fresh), 20_000):
            part = self.fresh[k : k + 20_000]
            found = self.library.encode([w[1:] if w[0] == MARK else "\n" + w for w in part], num_threads=1)
            for w, c in zip(part, found, strict=True):
                if self.known[w] != pack(c if w[0] == MARK else c[2:]) and w != MARK:  # the mark alone is what the library adds
                    self.wrong.add(w)
        for w in self.fresh:
            if len(w) > SHORT:
                del self.known[w]
        self.fresh.clear()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """For each text its ids, begin and end among them, as little-endian 32-bit numbers, and whether they are the agenda's: those of the library count."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.parts(t) for t in texts]
        ids_of = self.known.__getitem__
        own = [b"".join([self.begin, *map(ids_of, ws), self.end]) for ws in cut]
        self._check_parts()
        out = []
        for t, ws, ids in zip(texts, cut, own, strict=True):
            seams = {a[-1] + b[0] for a, b in zip(ws, ws[1:], strict=False)}
            right = self.wrong.isdisjoint(ws) if self.wrong else True
            if seams <= self.seams and right:
                out.append((ids, True))
                continue
            whole = pack(self.library.encode(t, add_bos=True, add_eos=True))
            if right and whole == ids:
                self.seams |= seams
            out.append((whole, whole == ids))
        return out


class _Known(dict):
    """The ids of parts; those of a part that isn't there are found by the agenda."""

    def __init__(self, agenda: Agenda):
        super().__init__()
        self.agenda = agenda

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = pack(self.agenda.word_ids(word))
        self.agenda.fresh.append(word)
        return ids


_loaded: dict[str, Agenda] = {}


def _agenda(model: str) -> Agenda:
    if model not in _loaded:
        _loaded[model] = Agenda(model)
    return _loaded[model]


def _slices(b: pa.RecordBatch, column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows with about ``chars`` bytes of text at most, so that lists of ids stay small."""
    size = [len(t) if t is not None else 0 for t in b.column(column).to_pylist()]
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > chars:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield b.slice(start)


def _encoded(model: str, keep: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = _agenda(model)
        for whole in batches:
            for b in _slices(whole, "text"):
                texts = b.column("text").to_pylist()
                made = agenda.encode(texts)
                numbers = [np.frombuffer(ids, "<u4") for ids, _ in made]
                decoded = [agenda.library.decode(n.tolist()) for n in numbers]
                columns = [b.column(c) for c in keep] + [
                    pa.array([len(n) for n in numbers], pa.int64()),
                    pa.array([sha256(ids).hexdigest() for ids, _ in made]),
                    pa.array([sha256(d.encode()).hexdigest() for d in decoded]),
                    pa.array([ok for _, ok in made], pa.bool_()),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids for ids, _ in made), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, *keep: str, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs``, then n_tokens, ids_sha256, decoded_sha256, agrees and, if asked for, ids."""
    fresh = ["n_tokens", "ids_sha256", "decoded_sha256", "agrees", "ids", "text"]
    kept = [c for c in keep if c not in fresh]
    own = docs.select(*(docs[c] for c in kept), whole_text().alias("text"))
    schema = [*(own.schema[c] for c in kept), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("agrees", BooleanType())]
    if with_ids:
        schema.append(StructField("ids", ArrayType(IntegerType())))
    return map_arrow(own, _encoded(model or default_model(), kept, with_ids), StructType(schema))


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """``tokens`` with ``text``: what the library decodes from ``ids`` (null for null)."""
    path = model or default_model()
    kept = [c for c in tokens.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _agenda(path).library
        for b in batches:
            texts = [None if i is None else sp.decode(i) for i in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return map_arrow(tokens.select(*kept), run, StructType([*(tokens.schema[c] for c in kept), StructField("text", StringType())]))

"""Exact encoding and decoding with a SentencePiece model of the merge type (operator 6), by backtracking."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments remembered per task; when full the memory starts anew, which changes no result.
REMEMBERED = 500_000
#: Segments of more characters aren't remembered.
LONGEST = 64


class Encoder:
    """Pieces and scores of a model file; ``encode`` gives ids as the model's library does, ``decode`` the text back."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        if sp.normalize(" Ａ  b\t") != f"{SPACE * 2}Ａ{SPACE * 2}b\t":
            raise ValueError("the model changes texts before encoding; only identity normalisation with a leading blank is covered")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {self.pieces[i]: (-sp.get_score(i), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces with a blank after text aren't covered")
        # a boundary that lies in no piece is never merged over, so what stands between two such boundaries is encoded alone
        ends = "".join(c for c in "\n\t" if not any(c in p for p in self.rank))
        self.pattern = re.compile(rf"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|[{ends}]+" if ends else ""))
        self.words = ahocorasick.Automaton()
        for p in self.rank:
            self.words.add_word(p, len(p))
        self.words.make_automaton()
        self.number = {p: i for p, (_, i) in self.rank.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.text = [(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
                     for i, p in enumerate(self.pieces)]

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for two adjacent pieces: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1]: best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges leave the two pieces as they are, side by side; after nothing, whether they make the piece at all."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        ok = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def next_shorter(self, piece: str) -> str:
        """The longest piece that begins this one and is shorter; a single character counts as one, before it there is none."""
        n = len(piece) - 1
        while n > 1 and piece[:n] not in self.rank:
            n -= 1
        shorter = self.shorter[piece] = piece[:n]
        return shorter

    def split(self, text: str) -> list[str]:
        """The pieces of a segment. Longest match first; a piece that doesn't fit the one before gives way to the next
        shorter, and when none is left the position has failed: its bit is set, it is never tried again, and the piece that led there is taken back."""
        longest = {end - n + 1: n for end, n in self.words.iter(text)}  # matches come by their ends, so the longest is the last of each beginning
        n, pos, failed, last, path = len(text), 0, 0, "", []
        fits, shorter = self.fits, self.shorter
        piece = text[: longest.get(0, 1)]
        while True:
            while piece:
                if not failed >> pos + len(piece) & 1 and ((ok := fits.get((last, piece))) or ok is None and self.compatible(last, piece)):
                    break
                piece = piece[:0] if len(piece) == 1 else shorter.get(piece) or self.next_shorter(piece)
            if piece:
                path.append(piece)
                pos += len(piece)
                if pos == n:
                    return path
                last, piece = piece, text[pos: pos + longest.get(pos, 1)]
                continue
            if not path:
                raise AssertionError(f"no encoding of {text!r}")
            failed |= 1 << pos
            taken = path.pop()
            pos -= len(taken)
            last = path[-1] if path else ""
            piece = "" if len(taken) == 1 else shorter.get(taken) or self.next_shorter(taken)

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of one segment, remembered."""
        if (ids := self.known.get(text)) is None:
            out: list[int] = []
            for p in self.split(text):
                if (i := self.number.get(p)) is not None:
                    out.append(i)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in p.encode())
                else:
                    out.append(self.unknown)
            ids = tuple(out)
            if len(text) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def segments(self, text: str) -> list[str]:
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        parts = self.segments(text)
        ids = list(map(self.known.get, parts))
        if None in ids:
            ids = [self.segment(s) if x is None else x for s, x in zip(parts, ids)]
        return list(chain.from_iterable(ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the pieces in order, the blank that encoding put in front removed; byte runs that aren't UTF-8 become U+FFFD each."""
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def loaded(model_file: str) -> Encoder:
    if model_file not in _LOADED:
        _LOADED[model_file] = Encoder(model_file)
    return _LOADED[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): every whole text's ids and what they decode to.

    The text gets a leading blank, blanks become U+2581, and the text is cut where no piece of the model reaches across: before
    blanks, and around line ends and tabs. Within each segment Aho-Corasick finds the pieces at every position; the encoding is the one
    whose neighbours are all compatible, found by backtracking with a bitfield of failed positions. A bounded memory holds
    the segments met before. Memory is that of one text and its ids.

    Null or empty text: no ids. Repeated rows stay. Empty table: empty result. Null ids stay. Other columns are ignored.
    The model file must exist on every executor, as installed with the tokenizers; the driver doesn't ship it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = loaded(model_file)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                flat, ends, texts = array("i"), [0], []
                for t in part.column(1):
                    ids = enc.encode(t.as_py() or "")
                    flat.extend(ids)
                    ends.append(len(flat))
                    texts.append(enc.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")

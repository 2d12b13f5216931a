"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here, field by field, and rebuilt from the
library's parts: the normaliser, the metaspace marker, the pieces with their
scores (unigram models as they are; BPE models by ranking each way to join two
pieces by the score of the whole), and byte fallback.

No piece has the marker inside, so a text may be cut before each run of markers
without changing its tokens; the model is checked for this, and where it doesn't
hold, or bytes have no pieces, texts are encoded uncut. Cutting and looking cuts up
is done on arrays for a block of texts at once: a cut has a 64-bit number (see
``bytewords``), and only those that a worker hasn't met are encoded, together and
multithreaded. What has been met is remembered, up to CACHE_BYTES, from task to task;
long texts are read in pieces. Each block's tokens are decoded to bytes and compared
with it, so that equal numbers of different cuts can't pass unseen.

Parity is counted for every text: each cut, when it is first met, is also encoded by the
sentencepiece library, in the surroundings that make it a cut, and a row's count is
that of all its cuts. Since cuts don't act on each other, nothing is left out; as a
check of that very rule, of one document in AUDIT_EVERY, chosen by a hash of its id,
the whole text goes through the library too, and through the rebuilt tokenizer's own
decoder. Texts that are encoded uncut are all held against the library whole. Each text's tokens
are decoded through the pieces' bytes and compared with it.

The path of the model is a parameter; its bytes travel with the tasks, so that
executors need no copy of the file.

Defined cases: null and empty texts have no tokens and come back as empty;
repeated rows get equal tokens; a null doc_id is one more id; an empty table
gives an empty result; no column but doc_id and text is read, so others may have
any name. Ties of scores go to the leftmost join, as in the library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bytewords
from textquarry.llm.bytewords import U, mixed
from textquarry.llm.common import bounded_batches, table
from textquarry.llm.packing import Numbers

QUERY = "op2_sentencepiece"

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: About so many bytes of cuts' numbers and tokens are remembered; then remembering starts anew.
CACHE_BYTES = 36 << 20
#: What a remembered cut takes, about.
CUT_BYTES = 70
#: Texts are cut and encoded about so many bytes at a time.
PIECE = 1 << 17
#: One document in so many is held against the sentencepiece library as a whole, too.
AUDIT_EVERY = 50

#: Field numbers and values of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers as such, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    trim: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == PIECES:
                own = dict(fields(value))
                m.pieces.append(own.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                m.kinds.append(own.get(3, NORMAL))
            elif number == TRAINER:
                own = dict(fields(value))
                m.model_type, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == NORMALIZER:
                own = dict(fields(value))
                m.charsmap, m.add_prefix, m.trim = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        return m

    @property
    def unk(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def cuttable(self) -> bool:
        """Whether texts may be cut before markers: no piece goes on over one, and normalising doesn't look across cuts."""
        return not self.charsmap and not self.trim and self.add_prefix and not any(MARK in p.lstrip(MARK) for p in self.pieces)

    @property
    def newline_alone(self) -> bool:
        return not any("\n" in p for p in self.pieces if p != "\n")

    def merges(self) -> list[tuple[str, str]]:
        """All joins of two pieces to a third, best whole first. At equal scores the longer left part is first, as the leftmost join goes on growing."""
        own = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED)}
        joins = [(-s, -i, p[:i], p[i:]) for p, s in own.items() for i in range(1, len(p)) if p[:i] in own and p[i:] in own]
        return [(a, b) for _, _, a, b in sorted(joins)]

    def tokenizer(self, whole: bool = True):
        """A tokenizers.Tokenizer; not whole: for cuts, which are normalised already."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.model_type == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=self.unk, byte_fallback=self.byte_fallback)
        elif self.model_type == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type} is neither unigram nor BPE")
        tok = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if self.trim else []
        steps += [normalizers.Prepend(MARK)] if self.add_prefix else []
        if whole:
            tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.add_prefix else [])])
        return tok

    def piece_bytes(self) -> list[bytes]:
        """What each token stands for: text of pieces, the byte of byte pieces, nothing for control."""
        by_kind = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        return [by_kind.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(self.pieces, self.kinds, strict=True)]


class Codec:
    """A model ready to encode and decode. cache_bytes: how much it remembers of the cuts it has met."""

    def __init__(self, data: bytes, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.data, self.cache_bytes = data, cache_bytes
        self.model = Model.parse(data)
        self.cut = self.model.cuttable and self.model.byte_fallback
        self.line = self.model.newline_alone
        self.tok = self.model.tokenizer(whole=not self.cut)
        self.cutter = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if self.line else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        pieces = self.model.piece_bytes()
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.store = np.frombuffer(b"".join(pieces), np.uint8)
        self._reference = None
        self._forget()

    @property
    def reference(self):
        """The sentencepiece library's own processor, for the audit."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._reference

    def _forget(self) -> None:
        self.known = Numbers(self.cache_bytes // CUT_BYTES + bytewords.PIECE)
        self.ids, self.ends, self.wrong = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _pieces(text: bytes) -> Iterator[bytes]:
        """text, whose markers are blanks, in parts of about PIECE bytes, parted where a run of blanks begins."""
        begin = 0
        while begin < len(text):
            end = begin + PIECE
            while 0 < end < len(text) and not (text[end] == 0x20 and text[end - 1] != 0x20):
                end = text.find(b" ", end + 1)
            end = len(text) if end < 0 else min(end, len(text))
            yield text[begin:end]
            begin = end

    def _places(self, theirs: list[int], own: list[int]) -> int:
        return sum(a != b for a, b in zip(theirs, own, strict=False)) + abs(len(theirs) - len(own))

    def _parity(self, cuts: list[str], found: list[list[int]]) -> list[int]:
        """The places at which the library's tokens of each cut are others. It puts a marker before a text by itself; what can't stand first is encoded behind, blanks alone before, a newline."""
        encode = lambda texts: self.reference.encode(texts, num_threads=1)
        line = encode("\n")  # a marker and a newline
        kind = [0 if not self.line else 1 if not c.startswith(" ") else 0 if c.strip(" ") else 2 for c in cuts]
        asked = [c[1:] if k == 0 else c[1:] + "\n" if k == 2 else c if c == "\n" else "\n" + c for c, k in zip(cuts, kind, strict=True)]
        out = []
        for c, k, theirs, own in zip(cuts, kind, encode(asked), found, strict=True):
            expected = own if k == 0 else [*own, *line[1:]] if k == 2 else [*line[:1], *own] if c == "\n" else [*line, *own]
            out.append(0 if theirs == expected else self._places(theirs, expected))
        return out

    def _alone(self, piece: bytes) -> tuple[np.ndarray, int]:
        """(ids, places that differ) of a piece by the tokenizer, without remembering."""
        text = piece.decode()
        ids = [i for x in self._tokens(self.cutter.findall(text.replace(" ", MARK))) for i in x]
        return np.array(ids, np.int32), self._places(self.reference.encode(text[1:], num_threads=1), ids)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, the number of each piece's, the places of each piece that differ from the library's)."""
        x = np.frombuffer(b"".join(pieces), np.uint8)
        if len(x) <= bytewords.PIECE:
            found = self._block(pieces, x)
            if found is not None:
                return found
        alone = [self._alone(p) for p in pieces]
        return np.concatenate([a for a, _ in alone]), np.array([len(a) for a, _ in alone], np.int64), np.array([w for _, w in alone], np.int64)

    def _block(self, pieces: list[bytes], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if self.known.n * CUT_BYTES > self.cache_bytes:
            self._forget()
        size = np.array([len(p) for p in pieces], np.int64)
        blank = x == 0x20
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        if self.line:
            line = x == 0x0A
            starts |= line
            starts[1:] |= line[:-1]
        starts[np.cumsum(size) - size] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(bytewords._BYTE[x] * bytewords._PLUS[: len(x)], out=total[1:])
        number = mixed((total[end] - total[begin]) * bytewords._MINUS[begin] + (end - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        at = self.known.find(number)
        new = np.flatnonzero(at < 0)
        if len(new):
            unique, first = np.unique(number[new], return_index=True)
            self._learn(unique, x, begin[new[first]], end[new[first]])
            at[new] = self.known.find(number[new])
        ids, count = _gathered(self.ids, self.ends[:-1][at], np.diff(self.ends)[at])
        if not np.array_equal(_gathered(self.store, self.begin[ids], self.size[ids])[0], x):
            self._forget()
            return None
        of_piece = np.searchsorted(np.cumsum(size), begin, "right")
        whole = lambda values: np.bincount(of_piece, values, len(pieces)).astype(np.int64)
        return ids, whole(count), whole(self.wrong[at])

    def _learn(self, numbers: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        data = x.tobytes()
        cuts = [data[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        found = self._tokens([c.replace(" ", MARK) for c in cuts])
        self.ids = np.concatenate([self.ids, np.array([i for own in found for i in own], np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(own) for own in found])])
        self.wrong = np.concatenate([self.wrong, np.array(self._parity(cuts, found), np.int64)])
        self.known.add(numbers)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        return self.compared(texts)[:2]

    def compared(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end, the places of each text at which the library's tokens are others)."""
        texts = ["" if t is None else t for t in texts]
        if not self.cut:
            found = self._tokens(texts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.array([i for x in found for i in x], np.int32), bounds, np.array([self._places(self.reference.encode(t, num_threads=1), x) for t, x in zip(texts, found, strict=True)], np.int64)
        total, wrong, flat = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owner, size, total, wrong
            ids, count, places = self._encoded(held)
            flat.append(ids)
            total += np.bincount(owner, count, len(texts)).astype(np.int64)
            wrong += np.bincount(owner, places, len(texts)).astype(np.int64)
            held, owner, size = [], [], 0

        for i, t in enumerate(texts):
            for piece in self._pieces(b" " + t.replace(MARK, " ").encode()) if t else ():
                if held and size + len(piece) > PIECE:
                    flush()
                held.append(piece)
                owner.append(i)
                size += len(piece)
        if held:
            flush()
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(total)]), wrong

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The text of each list of tokens, through the pieces' bytes; bytes that are no UTF-8 are replaced."""
        skip = 1 if self.model.add_prefix else 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = ids[a:b]
            text = _gathered(self.store, self.begin[own], self.size[own])[0].tobytes()
            yield (text[skip:] if text[:1] == b" " else text).decode("utf-8", "replace")

    def differing(self, text: str, ids: np.ndarray) -> int:
        """The places at which ids differ from the library's tokens of text, and 1 more if the rebuilt decoder doesn't give text back."""
        theirs = np.array(self.reference.encode(text, num_threads=1), np.int32)
        n = min(len(theirs), len(ids))
        wrong = int((theirs[:n] != ids[:n]).sum()) + abs(len(theirs) - len(ids))
        return wrong + (self.tok.decode(ids.tolist(), skip_special_tokens=False) != text.replace(MARK, " "))


def _gathered(store: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces store[begin : begin + size], one after the other, and size."""
    total = int(size.sum())
    if not total:
        return store[:0], size
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    at += np.arange(total)
    return store[at], size


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def _codec(data: bytes) -> Codec:
    """A worker's own: what it has met is remembered for its next task."""
    return Codec(data)


def encode(documents: DataFrame, model: str = MODEL, audit_every: int = AUDIT_EVERY) -> DataFrame:
    """doc_id, n_tokens, ids, audited (as a whole, too), differing (places of the text where the library's tokens, or of an audited one the decoder's text, are others), round_trip."""
    bounded_batches(documents.sparkSession)
    data = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data)
        for batch in batches:
            texts, audited = batch.column("text").to_pylist(), batch.column("audited").to_pylist()
            ids, bounds, places = codec.compared(texts)
            same = [a == (b or "").replace(MARK, " ") for a, b in zip(codec.decode(ids, bounds), texts, strict=True)]
            wrong = [codec.differing(t or "", ids[a:b]) if own else n for t, own, a, b, n in zip(texts, audited, bounds[:-1], bounds[1:], places.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), lists, batch.column("audited"), pa.array(wrong, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "audited", "differing", "round_trip"])

    kind = dict(documents.dtypes)["doc_id"]
    audited = (F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(audit_every)) == 0).alias("audited")
    return documents.select("doc_id", "text", audited).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, audited boolean, differing long, round_trip boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of each row of tokens (doc_id, ids), by the rebuilt tokenizer's decoder; null and empty ids give an empty text."""
    bounded_batches(tokens.sparkSession)
    data = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _codec(data).tok
        for batch in batches:
            texts = tok.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


#: Tokens have no SQL form; a test holds those of every document against the sentencepiece library, and decodes them back.
ORACLE_SQL = None

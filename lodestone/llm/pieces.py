"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read field by field; normaliser, metaspace marker, piece
scores (unigram) or merges (BPE, from the scores) and byte fallback are rebuilt as a
``tokenizers.Tokenizer``. No piece has the metaspace marker behind another character,
so a text splits before each run of spaces without changing its encoding; the
distinct new parts of a batch are encoded once, joined to a few long strings in one
multithreaded call, and checked: they spell the text and equal the model's own library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LARGEST_MODEL, KEPT_PARTS, THREADS = 64 << 20, 100_000, 2
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    raw: bytes = b""


def parse_model(raw: bytes) -> PieceModel:
    model = PieceModel(raw=raw)
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.fold_spaces = bool(v)
    return model


def merges_by_score(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces whose join is a piece, best joined score first."""
    own = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score in own.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in own and piece[i:] in own]
        found += [(score, own[a], own[b], a, b) for a, b in splits]
    found.sort(key=lambda m: (-m[0], -m[1], -m[2]))
    return [(a, b) for *_, a, b in found]


def rebuild(model: PieceModel):
    """A ``tokenizers.Tokenizer`` of the model, for texts that begin with their first (metaspace) marker or plain text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges_by_score(model.pieces), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fold_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    text_steps = normalizers.Sequence(steps) if steps else None
    tokenizer.normalizer = normalizers.Replace(" ", MARK)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer, text_steps


def splits_at_spaces(model: PieceModel) -> bool:
    """Whether no piece has the marker behind another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind == NORMAL)


class Codec:
    """Encodes and decodes texts; numbers the parts it has seen and keeps their ids, KEPT_PARTS at most."""

    RUNS = 8  # strings of joined parts that one call encodes, spread over threads

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import pre_tokenizers

        self.model = parse_model(raw)
        self.tokenizer, self.steps = rebuild(self.model)
        self.joined, _ = rebuild(self.model)
        self.joined.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.library = SentencePieceProcessor(model_proto=raw)
        self.plain = self.model.dummy_prefix and not self.model.charsmap and not self.model.fold_spaces
        self.part = re.compile(" +[^ ]*|[^ ]+") if splits_at_spaces(self.model) else re.compile(".+", re.DOTALL)
        # What each piece spells: bytes of byte pieces, text (marker as space) of the others.
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes, self.good = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def normalise(self, text: str) -> str:
        text = self.steps.normalize_str(text) if self.steps else text
        return " " + text if text and self.model.dummy_prefix else text

    def _spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.spelled.__getitem__, ids)) == text.encode()

    def _one(self, part: str) -> tuple[list[int], bool]:
        """Ids of a part, and whether it spells back and (for models without a normaliser) has the library's ids."""
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        # A last single space alone would be the library's own prefix, so it is looked up.
        theirs = ids if not self.plain else [self.library.piece_to_id(MARK)] if part == " " else self.library.encode(part[1:])
        return ids, ids == theirs and self._spells(ids, part)

    def _learn(self, parts: list[str]) -> None:
        """Adds new parts. Those of one space and a word are encoded and compared joined; the others, or a run that differs, one by one."""
        simple = [k for k, p in enumerate(parts) if p[0] == " " and p[1:2] != " " and MARK not in p]
        sizes, good = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=bool)
        runs = [r for r in np.array_split(np.array(simple, dtype=np.int64), self.RUNS) if len(r)]
        texts = ["".join([parts[k] for k in r]) for r in runs]
        single = sorted(set(range(len(parts))) - set(simple))
        pieces: dict[int, np.ndarray] = {}
        found = []
        for r, text, e in zip(runs, texts, self.joined.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            if self._spells(ids, text) and (not self.plain or ids == self.library.encode(text[1:], num_threads=1)):
                sizes[r], good[r] = np.bincount(np.array(e.word_ids), minlength=len(r)), True
                found.append((r, np.array(ids, dtype=np.int32)))
            else:
                single += r.tolist()
        for k in single:
            ids, good[k] = self._one(parts[k])
            sizes[k], pieces[k] = len(ids), np.array(ids, dtype=np.int32)
        ends = np.cumsum(sizes)
        flat = np.zeros(int(sizes.sum()), dtype=np.int32)
        for r, ids in found:
            own = sizes[r]
            flat[np.repeat(ends[r] - own - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        for k, ids in pieces.items():
            flat[ends[k] - sizes[k] : ends[k]] = ids
        self.ids, self.sizes, self.good = np.concatenate((self.ids, flat)), np.concatenate((self.sizes, sizes)), np.concatenate((self.good, good))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts, their bounds, and for each text whether every part kept parity and spells back."""
        if len(self.known) > KEPT_PARTS:
            self._forget()
        known, findall = self.known, self.part.findall
        before, counts, numbers = len(known), [], []
        for text in texts:
            parts = findall(self.normalise(text))
            counts.append(len(parts))
            numbers += [known.setdefault(p, len(known)) for p in parts]
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        at = np.array(numbers, dtype=np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        take = self.sizes[at]
        ends = np.cumsum(take)
        ids = self.ids[np.repeat(begins[at] - (ends - take), take) + np.arange(int(take.sum()))]
        edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        bad = np.concatenate(([0], np.cumsum(~self.good[at])))
        bounds, parity = np.concatenate(([0], ends)).astype(np.int64)[edges], bad[edges[1:]] == bad[edges[:-1]]
        if not self.plain:  # a normaliser may work across parts, so whole texts are compared
            theirs = self.library.encode(list(texts), num_threads=THREADS)
            parity &= np.array([np.array_equal(ids[a:b], t) for a, b, t in zip(bounds[:-1], bounds[1:], theirs, strict=True)], dtype=bool)
        return ids, bounds, parity

    def decode(self, ids: list[int]) -> str:
        text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def model_bytes(path: str = MODEL_FILE) -> bytes:
    """The model file, read on the driver; it goes to tasks by broadcast and must be under 64 MB."""
    raw = Path(path).read_bytes()
    if len(raw) > LARGEST_MODEL:
        raise ValueError(f"{path} has {len(raw)} bytes; models up to {LARGEST_MODEL} are broadcast")
    return raw


def encode(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """One row per document: doc_id, n_tokens, token_ids, parity.

    Parity tells whether all parts of the text have the ids of the model's own library
    and decode back to the (normalised) text. Null and empty texts have no tokens and
    parity. Rows that repeat a doc_id are encoded each; other columns are ignored; an
    empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        own = codec(model.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1_000_000):
                    size += len(texts[j])
                    j += 1
                ids, bounds, parity = own.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds)), lists, pa.array(parity)], ["doc_id", "n_tokens", "token_ids", "parity"]
                )
                i = j
        codec.cache_clear()  # the next task builds it again; until then the worker holds nothing

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, apply, "doc_id long, n_tokens long, token_ids array<int>, parity boolean")


def decode(encoded: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of rows (doc_id, token_ids); null ids give a null text, no ids an empty one, no rows none."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "token_ids"), apply, "doc_id long, text string")

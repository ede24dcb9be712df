"""Operator 7 - vector bin packing of token sequences.

Examples are vectors (tokens, segments, loss-bearing tokens) and sequences have a limit on each. Every task packs
what it reads: whole sequences are cut off long examples, the rests go into a pool of bounded size, and a
sequence is filled by taking, again and again, the pool's example with the largest dot product between its vector and
the room left (both as shares of the limits) among those that fit. Where examples may be cut, the room that is left
in the end is filled with the head of the pool's largest example, so a task pads at most its last few sequences.
No shuffle; the pool keeps no token that is placed, so it holds less than a sequence for each of its examples.

Token ids are those of the ``tokenizers`` file given by its path. Words between spaces are looked up in a cache of
bounded size; a word not in it goes to a byte-pair encoder built from the same file, and texts where spaces meet other
white space or special tokens go to the full tokenizer.

Defined results: null text is an empty text (one piece, its end id); null ids stay null and repeated rows are packed each for
itself; null or empty loss spans are none; further columns are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

CACHE_WORDS = 1 << 20       # of a Python worker; beyond it the cache starts anew


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024
    pool: int = 2048        # examples a task keeps open
    cut: bool = True        # examples may be cut anywhere


# ------------------------------------------------------------------------------------------- token ids

def _byte_table() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = _byte_table()
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.quick_ids = self.quick.encode_ordinary
        self.cache: dict[str, bytes | None] = {}

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and the word; None where a space doesn't begin a token of its own."""
        ids = None if not word or word[0].isspace() else array("I", self.quick_ids(" " + word)).tobytes()
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The distinct words of all texts are looked up once."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        lost = object()
        known = [self.cache.get(w, lost) for w in words]
        known = [self._word(w) if x is lost else x for w, x in zip(words, known, strict=True)]
        whole = np.array([x is None for x in known] + [False])
        known = [x or b"" for x in known]
        sizes = np.fromiter((len(x) // 4 for x in known), np.int64, len(known))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        n = sizes[codes]
        n[ends[:-1]] = 0        # a text's first word has no space before it
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])]
        odd = whole[codes]
        odd[ends[:-1]] = False
        odd = np.concatenate([[0], np.cumsum(odd)])[ends]
        out = []
        for i, t in enumerate(texts):
            if any(x in t for x in self.special):
                out.append(np.asarray(self.full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
            elif odd[i + 1] > odd[i]:
                out.append(array("I", self.quick_ids(t)).tobytes())
            else:
                out.append(array("I", self.quick_ids(t.split(" ", 1)[0])).tobytes() + ids[upto[ends[i]]:upto[ends[i + 1]]].tobytes())
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------------------------------- packing

class Packer:
    """Places examples (key, ids, loss flags or None for all) into sequences; yields (key, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, trim: Callable | None = None):
        """``trim(key, start)``: the key of what an example has from ``start`` on, so that the pool holds no placed tokens."""
        self.trim = trim or (lambda key, start: key)
        self.lim, self.caps = limits, np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.items: list[tuple] = []                    # key, start, length, loss positions or None
        self.need = np.zeros((max(2, 2 * limits.pool), 3))
        self.sequence = 0

    def add(self, key, length: int, loss: np.ndarray | None = None) -> Iterator[tuple]:
        """loss: the sorted positions of loss-bearing tokens; None: all."""
        start, most = 0, min(self.lim.tokens, self.lim.loss) if loss is None else self.lim.tokens
        if self.lim.cut:
            while length - start >= most and self.lim.segments >= 1:
                n = self._fits(start, length - start, loss, self.lim.tokens, self.lim.loss)
                if n < most and loss is None:
                    break
                yield key, start, n, self.sequence, 0
                self.sequence += 1
                start += n
        elif length > most or loss is not None and len(loss) > self.lim.loss:
            yield key, 0, length, self.sequence, 0      # too large for any sequence: it stands alone
            self.sequence += 1
            return
        if start < length or length == 0:
            self._keep(key, start, length - start, loss)
        while len(self.items) >= self.lim.pool:
            yield from self._fill()

    def _losses(self, start: int, length: int, loss) -> int:
        return length if loss is None else int(np.searchsorted(loss, start + length) - np.searchsorted(loss, start))

    def _fits(self, start: int, length: int, loss, tokens: int, room: int) -> int:
        """The longest head of the example that fits."""
        n = min(length, tokens)
        if loss is None:
            return min(n, room)
        a = int(np.searchsorted(loss, start))
        return min(n, int(loss[a + room]) - start) if a + room < len(loss) else n

    def _keep(self, key, start, length, loss):
        i = len(self.items)
        if start and loss is not None:
            loss = loss[np.searchsorted(loss, start):].copy()
        self.items.append((self.trim(key, start) if start else key, start, length, loss))
        self.need[i] = length, 1, self._losses(start, length, loss)

    def _drop(self, i: int):
        """The last item takes the place of the one that goes."""
        last = self.items.pop()
        if i < len(self.items):
            self.items[i], self.need[i] = last, self.need[len(self.items)]

    def _fill(self) -> Iterator[tuple]:
        room, at = self.caps.copy(), 0
        while self.items and room[1] >= 1:
            need = self.need[:len(self.items)]
            fits = (need <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (need / self.caps) @ (room / self.caps), -1.0)
                i = int(score.argmax())
                key, start, n, _ = self.items[i]
                used = need[i].copy()
                self._drop(i)
            elif self.lim.cut and room[0] >= 1 and room[2] >= 1:
                i = int(need[:, 0].argmax())
                key, start, length, loss = self.items[i]
                n = self._fits(start, length, loss, int(room[0]), int(room[2]))
                if n < 1:
                    break
                used = np.array([n, 1, self._losses(start, n, loss)])
                self.items[i] = (self.trim(key, start + n), start + n, length - n, loss)
                self.need[i] = length - n, 1, self._losses(start + n, length - n, loss)
            else:
                break
            yield key, start, n, self.sequence, at
            at += n
            room = room - used
            if room[0] < 1:
                break
        self.sequence += 1

    def flush(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()


def _encoded(b: pa.RecordBatch, enc: Encoder, most: int = 4 << 20) -> Iterator[tuple]:
    """(key, ids) of each row; some millions of characters are encoded at once."""
    at, size, texts = 0, 0, []
    for i, t in enumerate(b.column(1)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= most or i == b.num_rows - 1:
            yield from zip(b.column(0).slice(at, len(texts)), enc.batch(texts), strict=True)
            at, size, texts = i + 1, 0, []


PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def loss_positions(enc: Encoder, text: str, spans: list[dict], n: int) -> np.ndarray:
    """The places, among ``n`` tokens, of those that hold a character of a span (start, length in code points); the end token bears loss
    if the text's last character does."""
    bears = np.zeros(len(text) + 1, bool)
    for x in spans:
        bears[x["start"]:x["start"] + x["length"]] = True
    bears[-1] = len(text) > 0 and bears[len(text) - 1]
    upto = np.concatenate([[0], np.cumsum(bears[:-1])])
    at = np.array(enc.full.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    own = upto[at[:, 1]] > upto[at[:, 0]]
    return np.flatnonzero(np.concatenate([own, [bears[-1]]])[:n])


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", end_id: int = 0,
         loss: str | None = None) -> DataFrame:
    """Rows (id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of every sequence, with their ids.

    ``loss`` names a column of loss-bearing spans of the text, as ``chat.format_windows`` writes them (null: none); then
    ``limits.loss`` counts their tokens, and each piece has ``loss_tokens``. Without it all tokens bear loss."""
    spans = F.lit(None).cast("string") if loss is None else F.coalesce(F.col(loss), F.array())
    df = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), spans.alias("_loss"))
    kind = df.schema["_id"].dataType
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        def trim(key, start):
            doc, tokens, begin, ids, bear = key
            return doc, tokens, start, ids[4 * (start - begin):], bear if bear is None else bear[np.searchsorted(bear, start):].copy()

        enc, packer = encoder(path), Packer(limits, trim)
        base = TaskContext.get().partitionId() << 40
        names = ["_id", *(x.split()[0] for x in piece.split(", "))]

        def rows(pieces):
            pieces = list(pieces)
            got = [(k[0], s, n, k[1], base + q, at, k[3][4 * (s - k[2]):4 * (s - k[2] + n)]) for k, s, n, q, at in pieces]
            if loss is not None:
                bear = [int(np.searchsorted(k[4], s + n) - np.searchsorted(k[4], s)) for k, s, n, _, _ in pieces]
                got = [(*x, y) for x, y in zip(got, bear, strict=True)]
            cols = list(zip(*got, strict=True)) if got else [[]] * len(names)
            kinds = [ids_type, *[pa.int64()] * 5, pa.binary(), pa.int64()][:len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        ids_type = pa.int64()
        for b in batches:
            ids_type, out, size = b.schema.field(0).type, [], 0
            for i, (key, ids) in enumerate(_encoded(b, enc)):
                ids += end
                n = len(ids) // 4
                bear = None if loss is None else loss_positions(enc, b.column(1)[i].as_py() or "", b.column(2)[i].as_py() or [], n)
                out += packer.add((key.as_py(), n, 0, ids, bear), n, bear)
                size += len(ids)
                if size > 16 << 20:
                    yield rows(out)
                    out, size = [], 0
            yield rows(out)
        yield rows(packer.flush())

    piece = PIECE if loss is None else f"{PIECE}, loss_tokens long"
    schema = T.StructType([T.StructField("_id", kind), *T.StructType.fromDDL(piece).fields])
    return df.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op7_vector_packing(spark, sf_dir):
    p = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_vector_packing": op7_vector_packing}
ORACLE: dict[str, str] = {}     # byte-pair encoding isn't SQL; see tests/llm/test_packing.py

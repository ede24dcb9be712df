"""Operator 4 - secret scans with a recursive decoding worklist.

Every text is scanned by fixed patterns. Then layers are unwrapped from a worklist: URL escapes, Unicode and character
escapes, base64 (also wrapped into lines, after a prefix, or over binary data), UTF-16, and gzip / zlib / bz2 / xz
payloads below base64, of any number of members. Each new layer, readable or not, is scanned and unwrapped again until
nothing new appears; a layer already seen at the same place ends a cycle. A find in a layer is reported at the span of
the original text it comes from (code points, end exclusive); in wrapped base64 these are the lines that hold it.

Rows are independent: one pass of ``mapInArrow``, no shuffle. A decompressed payload is read in blocks of
``BLOCK`` characters with an overlap of ``OVERLAP``, so a decompression bomb costs time but no memory.

Defined results: null text is an empty text (no spans); a null id stays null; repeated rows give repeated results;
columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Fixed by the contract: the patterns and least lengths of the three kinds, in this order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
# Base64 of either alphabet, or of both side by side, with its line breaks (also written as \\n, indented or quoted).
ALPHABET = "[A-Za-z0-9+/_-]"
BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>#*]*+")
BASE64 = re.compile(rf"""(?<!{ALPHABET})(?:{ALPHABET}{{1,15}}+{BREAK.pattern})?{ALPHABET}{{16,}}+(?:{BREAK.pattern}{ALPHABET}++(?=[ \t]*+(?:[\r\n"'\\<=]|\Z)))*+={{0,2}}""")
ONE_ALPHABET = re.compile(r"[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,}")
# How the payloads of MAGIC begin in base64, and UTF-16 text read byte by byte.
MARK64 = re.compile(r"H4sI|Qlpo|/Td6WFoA|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
WIDE = re.compile(r"(?:[\t\n\r -~]\0){6,}+|(?:\0[\t\n\r -~]){6,}+")
URLSAFE = str.maketrans("-_", "+/")
MAGIC = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
BLOCK, OVERLAP = 8 << 20, 64 << 10

Span = tuple[int, int, int]     # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The contract's finds in one text, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and where its characters come from: ``cuts`` are (start in this text, start, end in the parent text, whole);
    characters of a whole piece stand for all of it, others for one parent character each."""

    def __init__(self, text: str, parent: Layer | None = None, cuts: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.parent, self.cuts = text, parent, cuts

    def origin(self, start: int, end: int) -> tuple[int, int]:
        at: Layer | None = self
        while at is not None and at.parent is not None:
            starts = at.__dict__.setdefault("starts", [c[0] for c in at.cuts])
            a, b = at.cuts[bisect_right(starts, start) - 1], at.cuts[bisect_right(starts, end - 1) - 1]
            start, end = a[1] if a[3] else a[1] + start - a[0], b[2] if b[3] else b[1] + end - b[0]
            at = at.parent
        return start, end


def _escaped(run: str) -> str:
    if run[0] == "%":
        return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    if run[1] == "u":
        units = b"".join(int(x, 16).to_bytes(2, "big") for x in run.split("\\u")[1:])
        return units.decode("utf-16-be", "replace")
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    n = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def _replaced(layer: Layer, pattern: re.Pattern, unit: int) -> Layer | None:
    """The layer with all runs of escapes decoded. unit: characters of one escape in runs that map one to one."""
    parts, cuts, at, out = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        if m.start() > at:
            parts.append(layer.text[at:m.start()])
            cuts.append((out, at, m.start(), False))
            out += m.start() - at
        run = m.group()
        said = _escaped(run)
        width = 3 if run[0] == "%" else 6 if run[1] == "u" else 4 if run[1] == "x" else len(run)
        if len(said) * width == len(run):   # one character for each escape
            cuts += [(out + i, m.start() + i * width, m.start() + (i + 1) * width, True) for i in range(len(said))]
        else:
            cuts.append((out, m.start(), m.end(), True))
        parts.append(said)
        out += len(said)
        at = m.end()
    if not parts:
        return None
    if at < len(layer.text):
        parts.append(layer.text[at:])
        cuts.append((out, at, len(layer.text), False))
    return Layer("".join(parts), layer, cuts)


def _codec(head: bytes):
    if head.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head.startswith(b"\xfd7zXZ\x00") else zlib.decompressobj()


def _inflated(pieces: Iterator[bytes], starts: set[int]) -> Iterator[tuple[bool, bytes]]:
    """(first of a member, bytes) of the members of a compressed payload, to its end or to where it is damaged. ``starts``
    gets the place of each member in the payload, and -1 when the payload is whole."""
    codec, data, read = None, b"", 0
    while True:
        while codec is None:
            data, more = data.lstrip(b"\0") if starts else data, b""     # padding between members
            if len(data) < 6:
                more = next(pieces, b"")
                data, read = data + more, read + len(more)
            if not more:
                if not data.startswith(MAGIC):
                    starts.add(-1)
                    return
                starts.add(read - len(data))
                codec, first = _codec(data), True
        try:
            got = codec.decompress(data, BLOCK)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        if got:
            yield first, got
            first = False
        if codec.eof:
            codec, data = None, codec.unused_data
            continue
        data = getattr(codec, "unconsumed_tail", b"")
        if not data and getattr(codec, "needs_input", len(got) < BLOCK):
            data = next(pieces, b"")
            read += len(data)
            if not data:
                return


def _level(source: Callable[[], Iterator[tuple[bool, bytes]]], seen: set[bytes]) -> Iterator:
    """The texts of what ``source`` yields, in blocks, then (source, member places) of each compressed payload it starts or a
    member of it starts. Latin-1 keeps one character for a byte, and all that is looked for is ASCII."""
    digest, size, fresh, block, held, heads = hashlib.sha1(), 0, 0, bytearray(), bytearray(), []
    for first, piece in source():
        if first:
            heads = [h for h in heads if len(h[1]) < 6 or h[1].startswith(MAGIC)] + [[size, b""]]
        for h in heads[-6:]:
            h[1] += piece[:6 - len(h[1])] if len(h[1]) < 6 else b""
        digest.update(piece)
        size, fresh = size + len(piece), fresh + len(piece)
        block += piece
        if held is not None:
            held += piece
            held = held if size < BLOCK else None
        if len(block) >= BLOCK + OVERLAP:
            yield block.decode("latin-1")
            del block[:-OVERLAP]
            fresh = 0
    if fresh:
        yield block.decode("latin-1")
    if not size or digest.digest() in seen:     # a payload that holds itself
        return
    seen.add(digest.digest())
    covered: set[int] = set()
    for at, head in heads:
        if not head.startswith(MAGIC) or at in covered:
            continue
        own: set[int] = set()
        if held is not None:
            yield lambda at=at, own=own: _inflated(iter([bytes(held[at:])]), own)
        else:
            yield lambda at=at, own=own: _inflated(_from(source(), at), own)
        covered |= {at + x for x in own if x >= 0}


def _from(pieces: Iterator[tuple[bool, bytes]], at: int) -> Iterator[bytes]:
    for _, piece in pieces:
        if at < len(piece):
            yield piece[at:]
        at = max(0, at - len(piece))


def _decoded(word: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a base64 word in pieces; a last character that stands for no byte is left out."""
    for i in range(0, len(word), step):
        part = word[i:i + step]
        part = part[:-1] if len(part) % 4 == 1 else part
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def _payloads(word: str, whole: set[int]) -> Iterator[str]:
    """The texts below the compressed payload a base64 word starts with; ``whole`` gets -1 if it came to its end."""
    seen: set[bytes] = set()
    work = [_level(lambda: _inflated(_decoded(word), whole), seen)]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
        elif isinstance(x, str):
            yield x
        else:
            work.append(_level(x, seen))


def _wide(layer: Layer) -> Layer | None:
    """The layer with its runs of UTF-16 text (ASCII characters beside NULs) as plain characters."""
    parts, cuts, out = [], [], 0
    for m in WIDE.finditer(layer.text):
        said = m.group().replace("\0", "")
        cuts += [(out + i, m.start() + 2 * i, min(m.start() + 2 * i + 128, m.end()), True) for i in range(0, len(said), 64)]
        cuts.append((out + len(said), m.end() - 1, m.end(), True))
        parts.append(said + "\0")
        out += len(said) + 1
    return Layer("".join(parts), layer, cuts) if parts else None


def _base64_layers(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """The layers below a run of base64 characters, which may be wrapped into lines. Groups of four decode apart from each
    other, so what starts anywhere in the run is read at one of four alignments; compressed payloads start at their mark."""
    lines, at = [], m.start()     # (place in the joined run, start, end); a line of both alphabets is cut between them
    run = m.group().rstrip("=")
    ends = [(m.start() + s.start(), m.start() + s.end()) for s in BREAK.finditer(run)]
    joined = 0
    for end, after in [*ends, (m.start() + len(run), 0)]:
        line, cuts = layer.text[at:end], {0, end - at}
        if ("-" in line or "_" in line) and ("+" in line or "/" in line):
            cuts.update(x for y in ONE_ALPHABET.finditer(line) for x in y.span())
        cuts = sorted(cuts)
        lines += [(joined + x, at + x, at + y) for x, y in zip(cuts, cuts[1:])]
        joined, at = joined + end - at, after
    lines[-1] = (*lines[-1][:2], m.end())
    word = "".join(layer.text[a:b] for _, a, b in lines).rstrip("=").translate(URLSAFE)
    for k in range(4):
        said = b"".join(_decoded(word[k:])).decode("latin-1") if len(word) - k > 1 else ""
        cuts = [(0, lines[0][1], lines[0][2], True)]
        for (_, a, b), (s, c, d) in zip(lines, lines[1:]):
            if s <= k:
                cuts = [(0, c, d, True)]
                continue
            bits = 6 * (s - k)
            if bits % 8:    # a byte over the break
                cuts.append((bits // 8, a, d, True))
            cuts.append((-(-bits // 8), c, d, True))
        if said:
            yield Layer(said, layer, cuts)
    for mark in MARK64.finditer(word):
        i = bisect_right(lines, mark.start(), key=lambda x: x[0]) - 1
        end = lines[i + 1][0] if i + 1 < len(lines) else len(word)
        whole: set[int] = set()
        for said in _payloads(word[mark.start():end], whole):
            yield Layer(said, layer, [(0, *lines[i][1:], True)])
        if end < len(word) and -1 not in whole:
            for said in _payloads(word[mark.start():], set()):
                yield Layer(said, layer, [(0, lines[i][1], lines[-1][2], True)])


def _children(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (x := _replaced(layer, URL_RUN, 3)):
        yield x
    if ("\\" in text or "&#" in text) and (x := _replaced(layer, ESCAPE_RUN, 0)):
        yield x
    if "\0" in text and (x := _wide(layer)):
        yield x
    for m in BASE64.finditer(text):
        yield from _base64_layers(layer, m)


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those of every layer below the text, each at its place in ``text``; sorted, without repeats."""
    found = set(base_spans(text) if base is None else base)
    mark = lambda t: hashlib.sha1(t.encode("utf-8", "surrogatepass")).digest()
    work, seen = [_children(Layer(text))], {(mark(text), 0, len(text))}
    while work:     # the worklist holds one open layer for each depth
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        place = (mark(child.text), *child.origin(0, len(child.text))) if child.text else None
        if place is None or place in seen:
            continue
        seen.add(place)
        for start, kind, end in base_spans(child.text):
            at, to = child.origin(start, end)
            found.add((at, kind, to))
        work.append(_children(child))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by a mark; spans that overlap become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and the scan's columns."""
    df = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                every = all_spans(t, base)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[b.schema.names[0], *(x.split()[0] for x in SCAN_SCHEMA.split(", "))])

    schema = T.StructType([T.StructField("_id", df.schema["_id"].dataType), *T.StructType.fromDDL(SCAN_SCHEMA).fields])
    return df.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of secrets in ``text`` replaced; all rows and columns stay."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            said = [None if t is None else redacted(t, all_spans(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(said, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_recursive_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_recursive_scan": op4_recursive_scan}
ORACLE: dict[str, str] = {}     # regular-expression positions and decoded layers aren't SQL; see tests/llm/test_secrets.py

"""Operator 3 - token counts by dynamic programming shared over a trie of pre-tokens.

Texts are cut into pre-tokens; a pre-token's tokens are those of its best segmentation into pieces of a vocabulary, the sum of the
pieces' unigram scores being greatest (of equal sums, the fewest tokens). The best score of a prefix doesn't depend on
what follows, so the distinct pre-tokens are walked as a trie, in sorted order: forward scores are kept on a stack, cut
back to the common prefix with the pre-token before, and only the new suffix is computed. Terminal nodes keep the number
of tokens and the score; a document's count is the sum over its pre-tokens.

Each task does this for the texts it reads, portion by portion, with the terminals of all portions so far at hand (bounded
by ``TERMINALS``, then begun anew): no shuffle, as a corpus-wide table of pre-tokens would have to be joined with every
(document, pre-token) pair.

The pieces are those of a byte-level vocabulary file, so any bytes can be written. The file has no unigram scores; a piece's
score is that of Zipf's law for its rank, -log(rank + 1), ranks being the file's order (by frequency when it was made).

Defined results: null or empty text has no tokens; null ids stay; repeated rows get equal rows; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .packing import _byte_table, default_path

TERMINALS = 1 << 20
PORTION = 4 << 20       # characters


def zipf_pieces(path: str) -> dict[bytes, float]:
    """The pieces of a byte-level vocabulary file and their scores."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    stand, special = _byte_table(), {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(stand[c] for c in t): -math.log(i + 2) for t, i in spec["model"]["vocab"].items() if t not in special}


class PrefixTrie:
    """Best segmentations of pre-tokens; ``terminals`` has (tokens, score) by pre-token."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.terminals = pieces, {}
        self.longest = max(map(len, pieces))
        ends: dict[int, set[int]] = {}
        for p in pieces:    # the lengths of the pieces that end with a byte
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {b: sorted(x) for b, x in ends.items()}

    def insert(self, words) -> None:
        """Walks the trie of the given pre-tokens depth first and stores their terminals."""
        before, best, n = b"", [0.0], [0]
        get = self.pieces.get
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            del best[same + 1:], n[same + 1:]
            for i in range(same + 1, len(raw) + 1):
                top, least = -math.inf, 0
                for size in self.lengths[raw[i - 1]]:
                    if size > i:
                        break
                    s = get(raw[i - size:i])
                    if s is not None:
                        s += best[i - size]
                        if s > top or s == top and n[i - size] + 1 < least:
                            top, least = s, n[i - size] + 1
                best.append(top)
                n.append(least)
            before = raw
            self.terminals[word] = (n[-1], best[-1])


COUNTS = "n_pretokens long, n_tokens long, score double"


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_pretokens, n_tokens and the score of the best segmentation."""
    df = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        import public_tokenizers
        import regex

        cut, trie = regex.compile(public_tokenizers.PATTERN).findall, PrefixTrie(zipf_pieces(path))
        for b in batches:
            rows, some, size = [], [], 0
            for i, t in enumerate(b.column(1)):
                t = t.as_py() or ""
                some.append(cut(t))
                size += len(t)
                if size > PORTION or i == b.num_rows - 1:
                    if len(trie.terminals) > TERMINALS:
                        trie.terminals.clear()
                    known = trie.terminals
                    trie.insert({w for words in some for w in words if w not in known})
                    for words in some:
                        got = [known[w] for w in words]
                        rows.append((len(got), sum(x[0] for x in got), math.fsum(x[1] for x in got)))
                    some, size = [], 0
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True))],
                                             names=["_id", *(x.split()[0] for x in COUNTS.split(", "))])

    schema = T.StructType([T.StructField("_id", df.schema["_id"].dataType), *T.StructType.fromDDL(COUNTS).fields])
    return df.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op3_trie_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op3_trie_counts": op3_trie_counts}
ORACLE: dict[str, str] = {}

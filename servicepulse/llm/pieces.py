"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of the model holds a whitespace marker after another character,
no merge can cross the place where a marker follows an ordinary character.  A
normalised text then falls into chunks, each a run of markers and the
characters up to the next marker, and its ids are the chunks' ids in order.
Each task segments every distinct chunk once, by the library itself, keeps the
result in a table, and joins ids back by position.  Models without that
property are encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import map_batches

MARK = "▁"
#: A run of spaces or markers and what follows it; or what the text begins with.
_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: Chunks that a task keeps from one batch to the next.
_LIMIT = 300_000


class Codec:
    """Chunk -> ids joined by commas, filled as chunks are met; ``odd`` holds the
    decoded text of the chunks that do not decode to themselves."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.chunked = self._separable()

    def _separable(self) -> bool:
        """No piece has a marker after another character, spaces map to markers one
        to one, one marker is put before the text, and nothing else is rewritten."""
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            if MARK in p.lstrip(MARK):
                return False
        probe = " a  b\tc\néÅﬁ① "
        return self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _whole(self, text: str) -> tuple[int, str, str]:
        ids = self.sp.encode(text)
        return len(ids), ",".join(map(str, ids)), self.sp.decode(ids)

    def _fill(self, chunks: list[str]) -> None:
        """Segment chunks as they stand within a text.  The library puts one marker
        before what it encodes, so a chunk is handed over without its first marker."""
        segmented = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for c, ids, back in zip(chunks, segmented, self.sp.decode(segmented, num_threads=1)):
            # Nothing is put before an empty text: the chunk of one marker is that piece.
            self.table[c] = ",".join(map(str, ids)) if len(c) > 1 else str(self.sp.piece_to_id(MARK))
            if len(c) > 1 and back != c[1:]:
                self.odd[c] = " " + back

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids joined by commas, and their decoded text."""
        plain = [bool(t) and self.chunked and MARK not in t and "\x00" not in t for t in texts]
        chunks = [_CHUNK.findall(" " + t) if p else [] for t, p in zip(texts, plain)]
        new = sorted(set(chain.from_iterable(chunks)).difference(self.table))
        self._fill(new)
        of, odd = self.table.__getitem__, self.odd
        out = []
        for t, p, cs in zip(texts, plain, chunks):
            if p:
                ids = ",".join(map(of, cs))
                back = t if not odd or odd.keys().isdisjoint(cs) else "".join([odd.get(c, c) for c in cs])[1:]
                out.append((ids.count(",") + 1, ids, back))
            else:
                out.append(self._whole(t))
        if len(self.table) > _LIMIT:  # full: the early chunks, which are mostly frequent ones, stay
            for c in new:
                del self.table[c]
                odd.pop(c, None)
        return out


def encode(docs: DataFrame, path: str, *keep: str, ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (text).

    The ids are exactly the library's for the whole text, without begin or end
    ids; the digests are of the decimal ids joined by commas and of the decoded
    text.  A null text counts as empty and has no ids.  Repeated rows are each
    encoded; columns not in ``keep`` are ignored.  ``ids``: add the ids as array<int>.
    """

    def run(cols, codec):
        rows = codec.encode([t or "" for t in cols["text"].to_pylist()])
        out = {k: cols[k] for k in keep}
        out["n_tokens"] = pa.array([r[0] for r in rows], pa.int64())
        out["ids_sha256"] = [hashlib.sha256(r[1].encode()).hexdigest() for r in rows]
        out["decoded_sha256"] = [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]
        out["ids"] = [[int(i) for i in r[1].split(",") if i] for r in rows] if ids else None
        return out

    types = dict(docs.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keep) + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("text")), run, schema, lambda: Codec(path))

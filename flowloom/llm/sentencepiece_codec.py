"""Operator 1: SentencePiece encoding and decoding through a table of distinct chunks.

In a BPE model whose pieces hold the white space mark only at their start, no merge crosses the
point between another character and a mark. A text is therefore cut into chunks (marks and what
follows up to the next mark), a distinct chunk is segmented and its ids decoded once, and ids and
decoded strings are joined back by position. The table lives in the Python worker and outlives its
tasks, so no chunk is shuffled and a very frequent chunk is only a dictionary hit. Once holds for a
worker: for the first ``MAX_CHUNKS`` distinct chunks it meets; others are done once for each
megabyte of text (``TOGETHER_BYTES``) that has them.

Defined results: null and empty texts have the begin and end id only and decode to ""; U+2581 in a
text is what the model makes of it, a space; ids may repeat or be null, rows stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

MARK = "▁"
#: Distinct chunks that a worker keeps, about 20 MB.
MAX_CHUNKS = 100_000
#: Longer chunks are not kept beyond the texts they were found in.
MAX_KEPT_CHARS = 64
#: Text bytes whose new chunks are segmented together.
TOGETHER_BYTES = 1 << 20
#: Characters of new chunks that the library segments as one string.
STRING_CHARS = 1 << 14

_CHUNK = re.compile(r" +[^ ]*")


class Codec:
    """Encodes and decodes exactly as the library does with the same model."""

    def __init__(self, model: bytes):
        self.sp = sp = _processor(model)
        #: Whether the chunk table gives what the library gives; else whole texts are segmented.
        self.opens, self.chunked = _pieces(model)
        self.bos = np.uint32(sp.bos_id()).tobytes()
        self.eos = np.uint32(sp.eos_id()).tobytes()
        self.lone = np.uint32(sp.piece_to_id(MARK)).tobytes()
        #: Chunk -> ids; and what the ids of a chunk decode to where that is not the chunk itself.
        self.ids: dict[str, bytes] = {" ": self.lone}
        self.odd: dict[str, str] = {}

    def _decode(self, chunks: list[str], ids: list[list[int]]) -> None:
        for chunk, text in zip(chunks, self.sp.decode(ids), strict=True):
            if chunk != " " + text:  # decode() takes the first mark away
                self.odd[chunk] = " " + text

    def _segment(self, new: list[str]) -> None:
        """Puts new chunks into the table.

        Chunks with one mark are put end to end: in what the library makes of the string each begins
        with the only piece that opens with a mark. Their ids are decoded end to end too, and one by
        one where that is not the string. Those with several marks are segmented alone.
        """
        single, size, flush = [], 0, []
        several = [c for c in new if c[1:2] == " "]
        if several:
            found = self.sp.encode([c[1:] for c in several])
            self.ids.update((c, np.array(i, np.uint32).tobytes()) for c, i in zip(several, found, strict=True))
            self._decode(several, found)
        for c in new:
            if c[1:2] == " ":
                continue
            single.append(c)
            size += len(c)
            if size >= STRING_CHARS:
                flush.append(single)
                single, size = [], 0
        for part in [*flush, single] if single else flush:
            found = self.sp.encode("".join(part)[1:])
            ids = np.array(found, np.uint32)
            at = [*np.flatnonzero(self.opens[ids]).tolist(), len(found)]
            raw, spans = ids.tobytes(), list(zip(at[:-1], at[1:], strict=True))
            self.ids.update(zip(part, [raw[4 * a : 4 * b] for a, b in spans], strict=True))
            if self.sp.decode(found) != "".join(part)[1:]:  # some chunk decodes to something else
                self._decode(part, [found[a:b] for a, b in spans])

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text all ids as little-endian 32-bit integers, and the text they decode to."""
        if not self.chunked:
            out = []
            for t in texts:
                ids = [self.sp.bos_id(), *self.sp.encode(t), self.sp.eos_id()]
                out.append((np.asarray(ids, "<u4").tobytes(), self.sp.decode(ids)))
            return out
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        new = distinct.difference(self.ids)
        full = len(self.ids) + len(new) > MAX_CHUNKS
        self._segment(list(new))
        out, table, odd = [], self.ids, self.odd
        for chunks in cut:
            ids = b"".join(map(table.__getitem__, chunks))
            text = "".join([odd.get(c, c) for c in chunks]) if odd else "".join(chunks)
            out.append((self.bos + ids + self.eos, text[1:]))
        for c in new if full else [c for c in new if len(c) > MAX_KEPT_CHARS]:
            del table[c]
            odd.pop(c, None)
        return out


@lru_cache(2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


@lru_cache(2)
def _pieces(model: bytes) -> tuple[np.ndarray, bool]:
    """Which pieces open with the mark, and whether texts may be cut into chunks."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    own = range(len(pieces))
    bounded = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
    plain = sp.normalize(" aé\u0301ﬁ①  \n\t\x00b ") == f"{MARK}{MARK}aé\u0301ﬁ①{MARK}{MARK}\n\t\x00b{MARK}"
    return np.array([p.startswith(MARK) for p in pieces]), bounded and plain and not any(map(sp.is_unused, own))


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (begin and end included) and decoded text of every row: ``id, ids array<int>, decoded``."""
    model = _model(model_path)

    def make():
        codec = _codec(model)

        def kernel(texts):
            got = codec.encode_many(texts)
            return {"ids": [np.frombuffer(b, "<u4").astype(np.int32) for b, _ in got], "decoded": [d for _, d in got]}

        return kernel

    return map_text(docs, make, "ids array<int>, decoded string", id_col, text_col, TOGETHER_BYTES)


def digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row, hashed where the ids are made."""
    model = _model(model_path)

    def make():
        codec = _codec(model)

        def kernel(texts):
            got = codec.encode_many(texts)
            return {
                "n_tokens": [len(b) // 4 for b, _ in got],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b, _ in got],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in got],
            }

        return kernel

    return map_text(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, TOGETHER_BYTES)

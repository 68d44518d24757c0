"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over the model's pieces reads the normalised text once. At every position it
follows the output links through all pieces that end there, and each relaxes the best score of that
position (single-pass Viterbi over the pieces' stored scores). Characters that no piece covers cost
``least score - 10`` each and come out as their UTF-8 bytes' pieces (byte fallback), or as the unknown
id where the model has no byte pieces. Ties go to the longer last piece.

Scores are those stored in the model file. The ids are the best of the public library's n-best lattice
for the same file with its model type set to unigram; tests compare the two. A file trained as BPE holds the
merge ranks as scores, so its ids here are the best-scored segmentation and not the greedy merges.

Between words the automaton is back at a state where nothing ends across the border: no piece holds a
space mark after another character (checked when the model is read). So the best path of a text is
that of its words in a row, and words that recur take their ids from a bounded cache. A model with
pieces across words runs over whole texts instead.

Decoding joins the pieces, turns byte pieces back into bytes and space marks into spaces and takes
off the leading space that encoding put in front; ``decode(encode(t)) == t`` for every text without the
space mark itself.

Defined cases: null text counts as empty; an empty text has no ids; very long texts run in memory
proportional to one text; rows that repeat come back each; an empty table gives an empty result;
extra columns are kept by :func:`encode_column`, but for one named like its result, and ignored by the query; ids of
rows stay as they are, as nothing but the text leaves Arrow. The cache of words is bounded in number and in length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_written, documents, session, with_text

MARK = "▁"
#: Words in the cache of a worker, and the longest that it keeps: longer ones are encoded anew.
CACHE_WORDS, CACHED_LENGTH = 250_000, 64
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Ids of words as little-endian 32-bit bytes; bounded."""

    def __init__(self, viterbi: Callable[[str], list[int]]):
        self.viterbi = viterbi

    def __missing__(self, word: str) -> bytes:
        value = np.array(self.viterbi(word), "<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


class Codec:
    """Encoder and decoder over the pieces and scores of a model file."""

    def __init__(self, path: str | None = None, *, pieces: list[tuple[str, float]] | None = None, unknown: int = 0):
        """From a model file, or from ``pieces`` given as (piece, score) by id; ``<0xHH>`` are byte pieces."""
        skip: set[int] = set()
        if path is not None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            unknown = model.unk_id()
            pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
            skip = {k for k in range(len(pieces)) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k)}
        assert pieces is not None
        self.pieces, self.unknown = [p for p, _ in pieces], unknown
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        if len(self.bytes) < 256:
            self.bytes = {}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        normal = [k for k in range(len(pieces)) if k not in skip and k not in self.byte_of and k != unknown and self.pieces[k]]
        self.automaton = ahocorasick.Automaton()
        for k in normal:
            self.automaton.add_word(self.pieces[k], (len(self.pieces[k]), pieces[k][1], k))
        self.automaton.make_automaton()
        self.penalty = min([pieces[k][1] for k in normal], default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(MARK in self.pieces[k].lstrip(MARK) for k in normal)
        self.controls = skip - {unknown}
        self.words = Words(self.viterbi)

    def viterbi(self, text: str) -> list[int]:
        """Best segmentation of a normalised text, in one pass of the automaton."""
        n = len(text)
        best: list[float] = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        penalty, done = self.penalty, 0
        for end, (length, score, piece) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                # All pieces that end here are seen: an unknown character is the last resort.
                done += 1
                if best[done] < best[done - 1] + penalty and not self.single(text[done - 1]):
                    best[done], back[done] = best[done - 1] + penalty, (1, -1)
            value = best[end - length] + score
            # The automaton reports the longest piece first, so ties keep it.
            if value > best[end]:
                best[end], back[end] = value, (length, piece)
        for done in range(done + 1, n + 1):
            if best[done] < best[done - 1] + penalty and not self.single(text[done - 1]):
                best[done], back[done] = best[done - 1] + penalty, (1, -1)
        ids: list[int] = []
        at = n
        while at:
            length, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)  # a run of unknown characters is one id
            at -= length
        return ids[::-1]

    def single(self, char: str) -> bool:
        return self.automaton.exists(char)

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return np.array(self.viterbi(text), "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        pieces, byte_of, skip = self.utf8(), self.byte_of, self.controls
        for k in ids:
            if k in byte_of:
                out.append(byte_of[k])
            elif k not in skip:
                out += pieces[k]
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def utf8(self) -> list[bytes]:
        if not hasattr(self, "_utf8"):
            self._utf8 = [p.replace(MARK, " ").encode() for p in self.pieces]
            self._utf8[self.unknown] = " ⁇ ".encode()
        return self._utf8


@cache
def codec_at(model: str) -> Codec:
    """One codec a worker."""
    return Codec(model)


def encode_column(docs: DataFrame, model: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column`` as ``array<int>`` in ``into`` (replacing a column of that name)."""
    session(docs.sparkSession)

    def make():
        codec = codec_at(model)
        return lambda texts: {into: [np.frombuffer(codec.packed(t), np.int32) for t in texts]}

    return with_text(docs.drop(into), f"`{into}` array<int>", make, text=column, keep_text=True)


def decode_column(rows: DataFrame, model: str, column: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in ``column`` as ``into``."""
    session(rows.sparkSession)

    def make():
        codec = codec_at(model)
        return lambda lists: {into: [None if v is None else codec.decode(v) for v in lists]}

    return with_text(rows.drop(into), f"`{into}` string", make, text=column, keep_text=True)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_same: whether decoding gives the text back."""
    session(docs.sparkSession)

    def make():
        codec = codec_at(model)

        def work(texts: list[str | None]) -> dict[str, list]:
            ids = [codec.packed(t) for t in texts]
            same = [codec.decode(np.frombuffer(b, "<u4").tolist()) == (t or "") for b, t in zip(ids, texts, strict=True)]
            return {"n_tokens": [len(b) // 4 for b in ids], "ids_crc32": [zlib.crc32(b) for b in ids], "decoded_same": same}

        return work

    return with_text(docs.select("doc_id", "text"), "n_tokens bigint, ids_crc32 bigint, decoded_same boolean", make)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), model_path())


def encoded_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, source and the ids of every document: what a trainer reads, in the order in which ``docs`` were written."""
    rows = as_written(docs).select("doc_id", "source", "text")
    return encode_column(rows, model).select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))

"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents become token ids in one pass over the texts; what is longer than a
sequence is cut into whole sequences and a rest. Pieces are dealt at random (by a
hash) into groups of bounded size, and each group is packed by itself: pieces from
long to short go into the open sequence for which the sum of squared counts of open
sequences per remaining gap becomes smallest, and open a new one only when no gap is
large enough. A group wastes at most about one sequence of thousands.

Texts are tokenised word by word with a cache: the tokenizer's rules never join
across white space, so a text's ids are those of its words. Words the short way does
not cover exactly (outside Latin letters, special tokens) go through the tokenizer
itself.

Defined cases: null text is empty; an empty text is one piece with the closing id;
repeated rows are packed as separate pieces; equal lengths go by id and piece; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

SEQUENCE, CLOSING_ID = 2048, 0
#: Pieces per packing group, and words kept in a worker's cache, none of them longer than this.
GROUP_PIECES, CACHE_WORDS, CACHED_LENGTH = 4096, 100_000, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Little-endian ids of a text, as bytes, by a word cache."""

    # fixed values: the tokenizer's own pattern of pieces
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    #: White space that ``str.split`` and the tokenizer see alike, printable ASCII and Latin letters.
    ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
    LATIN = re.compile(r"[\x21-\x7e\xa1-įĲ-ɏ]+")

    def __init__(self, source: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        model, split = self.tokenizer.model, regex.compile(self.PIECES)
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(printable)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
        table = {b: c for b, c in shown.items() if c != chr(b)}
        whole, ascii_pieces, latin, normal = self.whole, self.ASCII_PIECES.findall, self.LATIN.fullmatch, unicodedata.normalize
        packers = [struct.Struct(f"<{n}I").pack for n in range(64)]

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= cache_words:
                    self.clear()
                ids = [t.id for t in model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(table))]
                out = packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()
                if len(piece) <= CACHED_LENGTH:
                    self[piece] = out
                return out

        pieces = self.pieces = Pieces()
        of = pieces.__getitem__

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= cache_words:
                    self.clear()
                if "<|" in word:
                    out = whole(word)
                elif word.isascii():
                    low = word.lower()
                    out = of(low) if low.isalpha() else b"".join(map(of, ascii_pieces(low)))
                elif latin(word):
                    low = normal("NFC", word).lower()
                    out = of(low) if low.isalpha() else b"".join(map(of, split.findall(low)))
                else:
                    out = whole(word)
                if len(word) <= CACHED_LENGTH:
                    self[word] = out
                return out

        self.words = Words()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids with the closing id, cut to sequences."""
    source = open(tokenizer_path or default_tokenizer(), encoding="utf-8").read()  # a fixed file of a few MB
    sent = docs.sparkSession.sparkContext.broadcast(source)
    name = ("tokenizer", zlib.crc32(source.encode()))

    def run(batches):
        encode, step, end = kept(name, lambda: WordTokenizer(sent.value)).encode, 4 * sequence, struct.pack("<I", CLOSING_ID)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + end
                for k in range(0, len(data), step):
                    part = data[k : k + step]
                    ids.append(doc_id)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, sequence: int, may_open: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the given order.

    Only the counts per gap matter for the choice; a gap's sequences are used last in, first out.
    With ``may_open``, the published rule, a new sequence is one more choice though a gap is
    large enough; an equal change goes to the fuller open sequence.
    """
    counts = np.zeros(sequence + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(sequence + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for n, size in enumerate(lengths.tolist()):
        rest = np.flatnonzero(counts[size:])  # gaps left over
        if len(rest):
            # half the change of the sum of squares, but for a constant; a full sequence is no longer open
            change = counts[rest] * (rest > 0) - counts[rest + size]
            left = int(rest[change.argmin()])
        if len(rest) and not (may_open and 2 * counts[sequence - size] + 1 < 2 * change.min() + (2 if left else 1)):
            at = open_by_gap[left + size].pop()
            counts[left + size] -= 1
        else:
            at, left = made, sequence - size
            made += 1
        bins[n], offsets[n] = at, sequence - left - size
        if left:
            open_by_gap[left].append(at)
            counts[left] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, may_open: bool = False) -> DataFrame:
    """``pieces_of`` with ``sequence_id`` and ``offset``."""
    # a token has about four bytes, so this is near the number of pieces
    text = F.col(f"`{text_col}`").cast("string")
    expected = docs.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / (4 * sequence)))).first()[0] or 0
    groups = max(1, -(-expected // group_pieces))
    pieces = pieces_of(docs, tokenizer_path, sequence, id_col, text_col)

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        rows = rows.drop_columns(["group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), sequence, may_open)
        return rows.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

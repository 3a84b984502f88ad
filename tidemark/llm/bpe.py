"""Byte-level BPE, encoding and decoding, exactly as the tokenizers library does it whole.

Texts up to PIECE characters are encoded where they are read. Longer ones become
pieces that any task can encode:

* A text is cut before a blank that stands alone between non-blanks, where the
  vocabulary's split pattern always breaks.
* A stretch without such a place is split by the library's own pre-tokenizer,
  and its words are encoded by the merges alone.
* A word longer than a piece is halved until its parts fit. The halves' tokens
  are joined up a tree, round by round: a window around each join is encoded
  anew and doubled until its first token is the left half's there and its last
  the right half's, or it reaches a half's end.

Such agreement proves the join. A merge is always the least by rank and place,
so merges on either side of a boundary that none crosses don't know of each
other: a sequence of tokens is an encoding just if each two neighbours are the
encoding of their bytes. Neighbours within the halves and within the window are;
the agreeing tokens stand in both.

Decoding runs over the token ids; a piece starts and ends between characters, so
the pieces' texts add up to the text.

Cases: null and empty texts have no tokens, and digests of nothing. Repeated rows
and null doc_ids count each. The library's special strings inside texts become
their tokens, as it does by default. An empty table gives no rows. Extra columns
are ignored. Very long texts are bounded by one row: a task holds one text's
tokens. Models whose merges don't depend on ranks alone are refused.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, scratch, table

#: Before a blank between two non-blanks (Unicode white space counts as blank).
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a piece, and distinct pieces that each generation of a worker's memory holds.
PIECE, REMEMBERED = 32_768, 400_000

PIECE_SQL = "text_id string, doc_id long, piece int, part int, parts int, raw boolean, text string"
IDS_SQL = "text_id string, doc_id long, piece int, part int, parts int, ids binary"
OUT_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("text_id", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("ids", pa.binary())])
PIECES = pa.schema([*[f for f in IDS if f.name != "ids"], ("raw", pa.bool_()), ("text", pa.string())])


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Memory(dict):
    """Pieces' ids; what an older generation knows, or a new encoding, fills it."""

    def __init__(self, bpe: Bpe, older: dict | None = None):
        self.bpe, self.older = bpe, dict(older or {})

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.bpe.piece(piece)
        self[piece] = ids
        return ids


class Bpe:
    """A tokenizer file's encoder: whole texts, words by merges alone, and joins of encodings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.words = Tokenizer(self.whole.model)
        made = json.loads(self.whole.to_str())
        model = made["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or made["normalizer"] or (made["pre_tokenizer"] or {}).get("type") != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level BPE {odd}")
        added = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.token = functools.lru_cache(maxsize=1 << 17)(self.whole.id_to_token)
        self.memory, self.odd = Memory(self), {}
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.decimal = [str(i) for i in range(size)]
        self.bytes = [self.decode([i]).encode() for i in range(size)]

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    def word(self, mapped: str) -> list[int]:
        """A word in the byte alphabet, by merges alone."""
        return self.words.encode(mapped, add_special_tokens=False).ids

    def joined(self, left: list[int], right: list[int], width: int = 4) -> list[int]:
        """The encoding of two encodings' bytes together."""
        while left and right:
            a, b = left[-width:], right[:width]
            between = self.word("".join(map(self.token, a + b)))
            if (len(a) == len(left) or between[0] == a[0]) and (len(b) == len(right) or between[-1] == b[-1]):
                return left[: len(left) - len(a)] + between + right[len(b) :]
            width *= 2
        return left + right

    def known(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by commas, and decoded text of each text, by way of a bounded memory of pieces' ids.

        A full memory becomes the older one of the next, whose pieces move over when they are met again.
        """
        out = []
        for s in texts:
            if len(self.memory) > REMEMBERED:
                self.memory = Memory(self, self.memory)
            pieces = CUT.sub("\0 ", s).split("\0") if "\0" not in s else [s]
            ids = ",".join(map(self.memory.__getitem__, pieces))
            decoded = "".join(self.odd.get(p, p) for p in pieces) if self.odd else s
            out.append((ids.count(",") + 1 if ids else 0, ids, decoded))
        return out

    def piece(self, text: str) -> str:
        """The ids of a piece, joined by commas; the piece is decoded too. Tokens whose own texts add up to the piece decode to it."""
        ids = self.encode(text)
        if b"".join([self.bytes[i] for i in ids]) != text.encode() and (decoded := self.decode(ids)) != text:
            self.odd[text] = decoded
        return ",".join([self.decimal[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    """The worker's encoder, kept from task to task."""
    return Bpe(path)


def stretches(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """The text in order, cut where it can be: pieces of at most `size` characters, and whole stretches (True) that can't be cut so."""
    at = 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            yield text[at:], False
            return
        i = text.rfind(" ", at + 1, end)
        while i > at and (text[i - 1].isspace() or text[i + 1].isspace()):
            i = text.rfind(" ", at + 1, i)
        if i > at:
            yield text[at:i], False
            at = i
            continue
        cut = CUT.search(text, end)
        last = cut.start() if cut else len(text)
        yield text[at:last], True
        at = last


def pieces(bpe: Bpe, text: str, size: int) -> Iterator[tuple[int, int, bool, str]]:
    """part, parts, raw and text of each piece; a raw one is words in the byte alphabet, with blanks between (that alphabet has none)."""
    for s, unsplit in stretches(text, size):
        if not unsplit:
            yield 0, 1, False, s
            continue
        for i, section in enumerate(bpe.special.split(s) if bpe.special else [s]):
            if i % 2:
                yield 0, 1, False, section
                continue
            some, held = [], 0
            for word, _ in bpe.whole.pre_tokenizer.pre_tokenize_str(section) if section else ():
                if some and held + len(word) > size:
                    yield 0, 1, True, " ".join(some)
                    some, held = [], 0
                if len(word) > size:
                    parts = 1 << (-(-len(word) // size) - 1).bit_length()
                    for k in range(parts):
                        yield k, parts, True, word[len(word) * k // parts : len(word) * (k + 1) // parts]
                else:
                    some.append(word)
                    held += len(word)
            if some:
                yield 0, 1, True, " ".join(some)


def _short(docs: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                found = bpe.known(part.column("text").to_pylist())
                cols = [[n for n, _, _ in found], [hexdigest(ids) for _, ids, _ in found], [hexdigest(s) for _, _, s in found]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), *map(pa.array, cols[1:])], schema=OUT)

    return docs.mapInArrow(run, OUT_SQL)


def _long(docs: DataFrame, model: str, size: int) -> DataFrame:
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text_id, start = uuid.uuid4().hex, 0
                for i, (part, parts, raw, s) in enumerate(pieces(bpe, text.as_py(), size)):
                    start = i if part == 0 else start  # the parts of a word have its first part's number
                    yield pa.RecordBatch.from_pylist([{"text_id": text_id, "doc_id": doc_id, "piece": start, "part": part, "parts": parts, "raw": raw, "text": s}], schema=PIECES)

    # Written once, so that a text's name stays whatever runs again later.
    path = scratch(spark, "bpe-pieces")
    docs.mapInArrow(cut, PIECE_SQL).write.parquet(path)
    found = spark.read.parquet(path)
    most = found.agg(F.max("parts")).first()[0] or 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            ids = []
            for s, raw in zip(b.column("text").to_pylist(), b.column("raw").to_pylist(), strict=True):
                if not raw:
                    ids.append(bpe.encode(s))
                    continue
                each = s.split(" ")
                known = dict(zip(dict.fromkeys(each), map(bpe.word, dict.fromkeys(each)), strict=True))
                ids.append([x for word in each for x in known[word]])
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in IDS.names[:-1]], pa.array([np.array(x, np.int32).tobytes() for x in ids], pa.binary())], schema=IDS)

    encoded = found.repartition("text_id", "piece", "part").mapInArrow(encode, IDS_SQL)
    if most > 1:
        tree = _tree(encoded.where("parts > 1"), model, most)
        encoded = encoded.where("parts = 1").unionByName(tree)

    def finish(group: pa.Table) -> pa.Table:
        bpe, group = encoder(model), group.sort_by("piece")
        ids = [x for raw in group.column("ids").to_pylist() for x in np.frombuffer(raw, np.int32).tolist()]
        row = {"doc_id": group.column("doc_id")[0].as_py(), "n_tokens": len(ids), "ids_sha256": hexdigest(",".join(map(str, ids))), "decoded_sha256": hexdigest(bpe.decode(ids))}
        return pa.Table.from_pylist([row], schema=OUT)

    return encoded.groupBy("text_id").applyInArrow(finish, OUT_SQL)


def _tree(parts: DataFrame, model: str, most: int) -> DataFrame:
    """Parts of words joined two by two until each word is one; a word that is whole passes."""

    def join(group: pa.Table) -> pa.Table:
        bpe, group = encoder(model), group.sort_by("part")
        first = group.slice(0, 1).to_pylist()[0]
        if group.num_rows == 1:
            return pa.Table.from_pylist([first], schema=IDS)
        left, right = (np.frombuffer(raw, np.int32).tolist() for raw in group.column("ids").to_pylist())
        joined = np.array(bpe.joined(left, right), np.int32).tobytes()
        return pa.Table.from_pylist([{**first, "part": first["part"] // 2, "parts": first["parts"] // 2, "ids": joined}], schema=IDS)

    for _ in range((most - 1).bit_length()):
        parts = parts.withColumn("pair", F.floor(F.col("part") / 2)).groupBy("text_id", "piece", "pair").applyInArrow(_without_pair(join), IDS_SQL)
    return parts


def _without_pair(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda group: f(group.select(IDS.names))


def round_trip(docs: DataFrame, model: str, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long = F.length("text") > piece
    return _short(rows.where(~long), model).unionByName(_long(rows.where(long), model, piece))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Token-ID files in directly addressable codes.

A file set is a Parquet table of segments in the order of the documents. A segment holds the ids of some whole
documents in directly addressable codes (Brisaboa, Ladra and Navarro, 2013): level 0 has the low 8 bits of every
id, and a bitmap that tells which ids go on; level 1 has the next 8 bits of those that do, with a bitmap of its
own, and so on. A directory beside each bitmap counts the ones before every 512th bit, so the place of an id's
next chunk is one look-up and one short count: any id can be read without decoding those before it.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import shared_folder
from .common import small

CHUNK = 8
BLOCK = 512
#: A segment is closed after so many ids, at the end of a document.
SEGMENT = 1 << 16
#: Pieces and chunks of text whose ids a Python worker remembers; it only saves time.
REMEMBERED = 1_000_000
#: The bound where a worker gives back what it remembers at the end of each task, as other operators use it next.
LEAN = 300_000
SCHEMA = "shard int, segment int, start long, doc_ids array<long>, lengths array<long>, codes binary"

# White space as Unicode lists it. A pre-token of the byte-level pattern never goes on from a letter or digit to
# anything else, nor from any other character to white space, so a text may be cut there.
_WS = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_OTHER_ASCII = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_OTHER = _OTHER_ASCII + tuple(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PLAIN = re.compile(rf" ?[^{_WS}]+")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _KEPT)}
_SIMPLE = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_PIECE = re.compile(rf"[{_WS}]*(?:[^\W_]+|(?:[^\w{_WS}]|_)+[^\W_]*)|[{_WS}]+")


def encode_codes(ids: np.ndarray) -> bytes:
    """Ids (below 2^32) as directly addressable codes."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.r_[np.uint32(0), np.cumsum(ones, dtype=np.uint32)][:len(ones)]
        out += [struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
        rest = more[goes_on]
        if not len(rest):
            return struct.pack("<I", len(out) // 4) + b"".join(out)


class Codes:
    """Reader of ``encode_codes``."""

    def __init__(self, blob: bytes):
        self.levels, at = [], 4
        for _ in range(struct.unpack_from("<I", blob)[0]):
            n = struct.unpack_from("<I", blob, at)[0]
            chunks = np.frombuffer(blob, np.uint8, n, at + 4)
            bitmap = np.frombuffer(blob, np.uint8, -(-n // 8), at + 4 + n)
            ranks = np.frombuffer(blob, "<u4", -(-n // BLOCK), at + 4 + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += 4 + n + len(bitmap) + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``."""
        out, places, size = np.zeros(n, dtype=np.uint32), np.arange(n), n
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not size:
                break
            out[places] |= chunks[start:start + size].astype(np.uint32) << np.uint32(CHUNK * k)
            bits = np.unpackbits(bitmap[start // 8:(start + size + 7) // 8], bitorder="little")[start % 8:][:size]
            block = start // BLOCK
            before = np.unpackbits(bitmap[block * BLOCK // 8:start // 8 + 1], bitorder="little")[:start - block * BLOCK]
            start = int(ranks[block]) + int(before.sum())
            places = places[bits == 1]
            size = len(places)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, 1)[0])


@cache
def _tokenizer(path: str):
    """The tokenizer, its added tokens if texts without them may be cut into pieces, and what this worker remembers:
    the ids of pieces and those of chunks."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    spec = json.loads(Path(path).read_text())
    pre = spec.get("pre_tokenizer") or {}
    cut = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
           and spec.get("normalizer") is None and not any("\n" in a for a in added)
           and len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1)
    return tokenizer, added if cut else None, {}, {}


def even(text: str) -> bool:
    """Whether the white space of a text is single blanks and line feeds, none at the beginning.

    Before each of them such a text may be cut without parting a pre-token.
    """
    return not (text[:1].isspace() or any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER))
                or any(c in text for c in ("  ", "\n\n", " \n", "\n ")))


def chunks_of(text: str) -> list[str]:
    """An even text with a line feed before it, cut before every blank and line feed; the blank of a chunk is left out."""
    return ("\n" + text.replace("\n", " \n")).split(" ")


def forget(path: str) -> None:
    """Give back what this worker remembers."""
    _, _, pieces, chunks = _tokenizer(path)
    pieces.clear()
    chunks.clear()


def encode_texts(texts: list[str], path: str, plain: bool = False, lean: bool = False) -> list[np.ndarray]:
    """The ids of each whole text, as the tokenizer gives them by default, without adding special tokens.

    An added token in a text is an id of its own, and may reach across pieces: such a text is encoded as a whole.
    With ``plain`` added tokens are text like any other. With ``lean`` less is remembered.
    """
    tokenizer, added, pieces, chunks = _tokenizer(path)
    if tokenizer.encode_special_tokens != plain:
        tokenizer.encode_special_tokens = plain
    out: list[np.ndarray] = [None] * len(texts)
    whole, found, cut_up = [], [], []
    for i, t in enumerate(texts):
        if added is None or not plain and any(a in t for a in added):
            whole.append(i)
        elif even(t):
            cut_up.append((i, chunks_of(t)))
        else:
            found.append((i, _PIECE.findall(t)))
    for i, e in zip(whole, tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
        out[i] = np.array(e.ids, dtype="<u4")
    for known, cuts, learn, skipped in ((pieces, found, _learn_pieces, 0), (chunks, cut_up, _learn_chunks, 1)):
        present = set().union(*[c for _, c in cuts])
        if len(pieces) + len(chunks) + len(present) > (LEAN if lean else REMEMBERED):
            forget(path)
        learn(list(present.difference(known)), tokenizer, known, pieces)
        for i, cut in cuts:
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, cut)), dtype="<u4")[skipped:]
    return out


def _ids_of(pieces: list[str], tokenizer) -> Iterator[bytes]:
    """The ids of pieces with one blank at most, which may lead; none has a line feed.

    They travel in one text with a line feed after each, which is a pre-token and an id of its own there; this saves
    a call for each piece.
    """
    line_feed = tokenizer.encode("\n", add_special_tokens=False).ids[0]
    for at in range(0, len(pieces), 64):
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(pieces[at:at + 64]) + "\n"], add_special_tokens=False)[0].ids,
                       dtype="<u4")
        ends = (4 * np.flatnonzero(ids == line_feed)).tolist()
        raw = ids.tobytes()
        yield from (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends))


def _learn_pieces(fresh: list[str], tokenizer, known: dict[str, bytes], _) -> None:
    plain = [p for p in fresh if _PLAIN.fullmatch(p)]
    known.update(zip(plain, _ids_of(plain, tokenizer)))
    rest = [p for p in fresh if p not in known]
    known.update((p, np.array(e.ids, dtype="<u4").tobytes())
                 for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)))


def _ids_of_word(word: str, tokenize) -> bytes:
    """The ids of a blank and a word of one kind of characters; blanks are U+0120 in a byte-level vocabulary."""
    seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LEVEL)
    return array("I", [t.id for t in tokenize("\u0120" + seen)]).tobytes()


def _learn_chunks(fresh: list[str], tokenizer, known: dict[str, bytes], pieces: dict[str, bytes]) -> None:
    """Add the ids of chunks. Where the pre-tokens of a chunk are plain, their ids are shared among chunks: the first one
    is a chunk of its own, the others are pieces, so that nothing is remembered twice."""
    tokenize = tokenizer.model.tokenize
    lines, words = [], []
    for c in fresh:
        if c[:1] == "\n":
            lines.append(c)
            continue
        if c.isalpha() and max(c) < "\u0250":                # Latin letters: one pre-token with the blank
            known[c] = _ids_of_word(c, tokenize)
        elif c.isascii() and c.isprintable() and c and "'" not in c:
            first, *rest = _SIMPLE.findall(c)
            if first not in known:
                known[first] = _ids_of_word(first, tokenize)
            if rest:
                for part in rest:
                    if part not in pieces:
                        pieces[part] = array("I", [t.id for t in tokenize(part)]).tobytes()
                known[c] = known[first] + b"".join(map(pieces.__getitem__, rest))
        else:
            words.append(c)
    words = [w for w in words if w]
    known.update(zip(words, _ids_of([" " + w for w in words], tokenizer)))
    feed = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<u4").tobytes()
    bare = [c for c in lines if len(c) > 1]
    known.update((c, feed + ids) for c, ids in zip(bare, _ids_of([c[1:] for c in bare], tokenizer)))
    known["\n"] = feed
    known[""] = np.array(tokenizer.encode(" ", add_special_tokens=False).ids, dtype="<u4").tobytes()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                 text: str = "text", lean: bool = False) -> None:
    """Write the ids of all documents to ``path``, in ascending order of id, null ids first.

    Each document ends with ``end_id``. Null text is an empty text. Rows of equal id stand in the order of a
    hash of their texts. Texts travel to range partitions; a partition is a shard of the file set. With ``lean``
    workers remember less, and nothing after a task.
    """
    slim = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(text)).alias("hash"), col(text).alias("text"))
    ordered = slim.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, segment, start, shard = [], [], 0, 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                 pa.array([encode_codes(np.concatenate(held))], pa.binary())], names=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(2).to_pylist()]
                shard = part.column(3)[0].as_py()
                for i, coded in zip(part.column(0), encode_texts(texts, tokenizer, lean=lean)):
                    held.append(np.append(coded, np.uint32(end_id)))
                    ids.append(i.as_py())
                    size += len(held[-1])
                    if size >= SEGMENT:
                        yield row()
                        held, ids, size, segment, start = [], [], 0, segment + 1, start + size
        if held:
            yield row()
        if lean:
            forget(tokenizer)

    fields = ["shard", "segment", "start", "doc_ids", "lengths", "codes"]
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a file set; ``start`` counts all ids before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    ends = rows.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)      # a row per written partition
    offsets = ends.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), F.col("shard") == F.col("__shard")).withColumn(
        "start", F.col("start") + F.col("__before")).drop("__shard", "__before")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, lengths = Codes(r["codes"]), np.array(r["lengths"], dtype=np.int64)
                starts = np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(codes.slice(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for each ``position`` of a table; only the segments they lie in are read beyond their spans."""
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    spans = segments(spark, path).select("start", (F.col("start") + size).alias("end"), "codes")
    met = small(positions.select("position")).join(spans, (F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Codes(r["codes"])[r["position"] - r["start"]] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["position", "token"])

    return met.select("position", "start", "codes").mapInArrow(run, "position long, token long")


def tokens_of(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text",
              lean: bool = False) -> DataFrame:
    """Write the documents' ids to the shared folder and return what ``token_digests`` reads there."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text, lean)
    return token_digests(docs.sparkSession, path)

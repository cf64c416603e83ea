"""Alignment of two tokenizers by the bytes of their tokens, with corpus-wide counts by external spill counting.

A token of one tokenizer is linked to every token of the other whose bytes it overlaps. How many documents hold an id
pair linked is counted outside of memory. Documents are gathered in runs of RUN records (pair, document). A run sorts
its different pairs by the side A id, then B, and counts its documents for each. These spills are cut by the radix of
the A id, packed with zstd and sent to the radix partitions. There a heap merges the runs of a partition, one A id at a
time, so that the counts of all its pairs and their maximum are known together; each run gets back the count of each
of its pairs. The records themselves stay with their run: a pair that every document holds is one entry for a run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import written
from .tokens import _learn_chunks, _tokenizer, encode_texts, even

#: A run is closed after so many records, at the end of a document.
RUN = 2_000_000
#: Chunks of text whose alignment a Python worker remembers; it only saves time.
REMEMBERED = 500_000
#: Radix partitions: as many as there are runs, within these bounds. The upper one is near the ids of a vocabulary.
LEAST_RADIX, MOST_RADIX = 16, 32_768

class Growing:
    """An array that rows are appended to."""

    def __init__(self, *shape: int):
        self.rows, self.size = np.zeros((1024, *shape), dtype=np.int64), 0

    def extend(self, values: list) -> None:
        if self.size + len(values) > len(self.rows):
            more = np.zeros((2 * (self.size + len(values)), *self.rows.shape[1:]), dtype=np.int64)
            more[:self.size] = self.rows[:self.size]
            self.rows = more
        if values:
            self.rows[self.size:self.size + len(values)] = values
            self.size += len(values)


_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[str], list[int]]:
    """Groups between common ends, as ``a1,a2|b1``, and the links as a << 32 | b; both sides cover the same bytes."""
    groups, links = [], []
    i = j = at_a = at_b = 0
    while i < len(a):
        first_a, first_b = i, j
        end_a, end_b = at_a + a_size[a[i]], at_b + b_size[b[j]]
        links.append(a[i] << 32 | b[j])
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a += a_size[a[i]]
            else:
                j += 1
                end_b += b_size[b[j]]
            links.append(a[i] << 32 | b[j])
        i, j, at_a, at_b = i + 1, j + 1, end_a, end_b
        groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
    return groups, links


class Aligner:
    """Two tokenizers and the chunks whose alignment is known: per chunk n_a, n_b, n_groups, its groups and links."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.path = path_a
        self.a, added, self.pieces, self.coded = _tokenizer(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = self._byte_level()
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        plain = [n for n in names if not _BYTE.fullmatch(n)]
        self.blank = self.b.piece_to_id("▁")
        # B joins nothing across the beginning of a blank or a line feed, and leaves texts as they are
        self.cut = (added is not None and not any("▁" in n.lstrip("▁") or "\n" in n for n in plain)
                    and self.b.id_to_piece(self.blank) == "▁" and self.b.encode("a  b") == self.b.encode("a") + [
                        self.b.piece_to_id("▁"), *self.b.encode("b")])
        self.forget()

    def _byte_level(self) -> list[bytes]:
        """The bytes of each id of A: characters of a byte-level vocabulary stand for bytes."""
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(kept)]
        of = {chr(b): bytes([b]) for b in kept} | {chr(0x100 + k): bytes([b]) for k, b in enumerate(others)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            out[i] = b"".join(of.get(c, c.encode()) for c in name)
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers, self.links, self.ends = Growing(3), Growing(), Growing()
        self.ends.extend([0])

    def ids(self, text: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """The ids, or None where the bytes of one side are not those of the text."""
        if b"".join([self.a_bytes[i] for i in a]) != text or b"".join([self.b_bytes[i] for i in b]) != text:
            return None
        return a, b

    def learn(self, fresh: list[str]) -> None:
        """Add chunks; one whose bytes do not come back is remembered as such by -1."""
        self.a.encode_special_tokens = True
        if len(self.pieces) + len(self.coded) > REMEMBERED:
            self.pieces.clear()
            self.coded.clear()
        _learn_chunks(fresh, self.a, self.coded, self.pieces)
        links, ends, numbers, last = [], [], [], self.links.size
        for c, b in zip(fresh, self.b.encode(fresh, num_threads=1)):
            if c[:1] == "\n":
                text, b = c.encode(), b[1:]
            else:
                text, b = b" " + c.encode(), b or [self.blank]
            both = self.ids(text, np.frombuffer(self.coded[c], dtype="<u4").tolist(), b)
            if both is None:
                self.known[c] = -1
                continue
            groups, pairs = align(*both, self.a_size, self.b_size)
            self.known[c] = len(self.groups)
            self.groups.append(";".join(groups))
            numbers.append((len(both[0]), len(b), len(groups)))
            links += pairs
            last += len(pairs)
            ends.append(last)
        self.numbers.extend(numbers)
        self.links.extend(links)
        self.ends.extend(ends)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Per text n_a, n_b, n_groups, the digest of its groups and its links."""
        cuts = [t.replace("\n", " \n").split(" ") if t and self.cut and even(t) else None for t in texts]
        present = set().union(*[c for c in cuts if c])
        if len(self.known) + len(present) > REMEMBERED:
            self.forget()
        self.learn(list(present.difference(self.known)))
        nothing = 0, 0, 0, "", np.zeros(0, np.int64)
        for text, cut in zip(texts, cuts):
            if not text:
                yield nothing
                continue
            at = np.fromiter(map(self.known.__getitem__, cut), dtype=np.int64, count=len(cut)) if cut else None
            if at is None or at.min() < 0:
                a = encode_texts([" " + text], self.path, plain=True)[0].tolist()
                both = self.ids((" " + text).encode(), a, self.b.encode(text))
                if both is None:
                    yield nothing
                    continue
                groups, links = align(*both, self.a_size, self.b_size)
                yield len(both[0]), len(both[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), np.array(links)
                continue
            first = self.ends.rows[at]
            sizes = self.ends.rows[at + 1] - first
            places = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, at.tolist())).encode()).hexdigest()
            yield *self.numbers.rows[at].sum(axis=0).tolist(), digest, self.links.rows[places]


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _pack(values: np.ndarray, dtype: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(dtype).tobytes())


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def _sorted_pack(codes: np.ndarray) -> bytes:
    return _pack(np.diff(codes, prepend=0), "<i8")


def _sorted_unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<i8"))


_DOCS = ("doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
         "sizes array<long>")
_RUNS = f"run long, {_DOCS}, pairs binary, holders binary, records binary, times binary"


def write_runs(docs: DataFrame, path_a: str, path_b: str, id_col: str, text: str) -> DataFrame:
    """Runs: the documents' figures; the pairs sorted by A, then B; documents a pair; the records (place of a pair, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, figures, pairs, times, held = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = [len(p) for p in pairs]
            different, place = np.unique(np.concatenate(pairs), return_inverse=True)
            columns = list(zip(*figures))
            values = [number, ids, *columns[:3], columns[4], columns[3], sizes, _sorted_pack(different),
                      _pack(np.bincount(place, minlength=len(different)), "<u4"), _pack(place, "<u4"), _pack(np.concatenate(times), "<u4")]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, (n_a, n_b, n_groups, digest, links) in zip(part.column(0).to_pylist(), aligner.documents(part.column(1).to_pylist())):
                    codes, counts = np.unique(links, return_counts=True)
                    ids.append(i)
                    figures.append((n_a, n_b, n_groups, digest, len(links)))
                    pairs.append(codes)
                    times.append(counts)
                    held += len(codes) + 8
                if held >= RUN:
                    yield closed()
                    ids, figures, pairs, times, held, number = [], [], [], [], 0, number + 1
        if ids:
            yield closed()

    lists = {"digests": pa.list_(pa.string())} | {n: pa.list_(pa.int64()) for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sizes")}
    names = [f.split()[0] for f in _RUNS.split(", ")]
    schema = pa.schema([(n, lists.get(n, pa.int64() if n == "run" else pa.binary())) for n in names])
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text).alias("text"))
    return written(slim.mapInArrow(run, _RUNS), "alignment-runs")


def _spilled(radix: int):
    """(part, run, pairs, holders): the spills of runs (run, pairs, holders), cut by the radix of the A id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, holders = _sorted_unpack(r["pairs"]), _unpack(r["holders"], "<u4")
                part = (codes >> 32) % radix
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[order], prepend=-1))
                cuts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[order[starts]].astype(np.int32)), pa.array(np.full(len(cuts), r["run"])),
                     pa.array([_sorted_pack(codes[c]) for c in cuts], pa.binary()),
                     pa.array([_pack(holders[c], "<u4") for c in cuts], pa.binary())], names=["part", "run", "pairs", "holders"])

    return run


def merge_runs(spills: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Count each pair over all spills (sorted codes, holders); per spill and pair count << 1 | best of its A id.

    A heap holds the next A id of each spill. All spills at the smallest one are taken together: they have all pairs
    of that id, so counts and their maximum are complete, and go back to the spills they came from at once.
    """
    sides = [codes >> 32 for codes, _ in spills]
    cuts = [np.r_[np.flatnonzero(np.diff(s, prepend=-1)), len(s)].tolist() for s in sides]
    keys = [s[c[:-1]].tolist() for s, c in zip(sides, cuts)]
    out = [np.zeros(len(codes), dtype=np.int64) for codes, _ in spills]
    heap = [(k[0], r, 0) for r, k in enumerate(keys) if k]
    heapq.heapify(heap)
    while heap:
        side, met = heap[0][0], []
        while heap and heap[0][0] == side:
            _, r, i = heap[0]
            met.append((r, cuts[r][i], cuts[r][i + 1]))
            if i + 1 < len(keys[r]):
                heapq.heapreplace(heap, (keys[r][i + 1], r, i + 1))
            else:
                heapq.heappop(heap)
        different, place = np.unique(np.concatenate([spills[r][0][a:b] for r, a, b in met]), return_inverse=True)
        counts = np.zeros(len(different), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([spills[r][1][a:b] for r, a, b in met]))
        answer = (counts << 1 | (counts == counts.max()))[place]
        at = 0
        for r, a, b in met:
            out[r][a:b] = answer[at:at + b - a]
            at += b - a
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, part, counts) from spills sorted by part."""
    def answer(rows: list[dict]) -> pa.RecordBatch:
        counts = merge_runs([(_sorted_unpack(r["pairs"]), _unpack(r["holders"], "<u4")) for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([r["run"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()),
             pa.array([_pack(c, "<i8") for c in counts], pa.binary())], names=["run", "part", "counts"])

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield answer(held)
                held = []
            held.append(r)
    if held:
        yield answer(held)


def _answered(radix: int):
    """The documents of a run with what the counts of its pairs add up to."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        codes = _sorted_unpack(r["pairs"])
        order = np.argsort((codes >> 32) % radix, kind="stable")
        value = np.zeros(len(codes), dtype=np.int64)
        blobs = right.sort_by("part").column("counts").to_pylist()
        value[order] = np.concatenate([_unpack(b, "<i8") for b in blobs]) if blobs else np.zeros(0, np.int64)
        of, times = value[_unpack(r["records"], "<u4")], _unpack(r["times"], "<u4").astype(np.int64)
        ends = np.cumsum(np.array(r["sizes"], dtype=np.int64))

        def summed(x: np.ndarray) -> pa.Array:
            total = np.r_[0, np.cumsum(x)]
            return pa.array(total[ends] - total[ends - r["sizes"]], pa.int64())

        return pa.table({"doc_id": pa.array(r["doc_ids"], pa.int64()), "n_a": pa.array(r["n_a"], pa.int64()), "n_b": pa.array(r["n_b"], pa.int64()),
                         "n_groups": pa.array(r["n_groups"], pa.int64()), "n_links": pa.array(r["n_links"], pa.int64()),
                         "n_best": summed((of & 1) * times), "count_sum": summed((of >> 1) * times), "groups_sha256": pa.array(r["digests"])})

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentencepiece model that puts a blank in front. Rows are
    documents, repeated rows and rows of null id included. Null and empty texts, and texts that one side does not give
    back, have zeros and no digest, and hold no pair.
    """
    runs = write_runs(docs, path_a, path_b, id_col, text)
    radix = min(max(runs.count(), LEAST_RADIX), MOST_RADIX)
    spills = runs.select("run", "pairs", "holders").mapInArrow(_spilled(radix), "part int, run long, pairs binary, holders binary")
    counted = spills.repartition("part").sortWithinPartitions("part", "run").mapInArrow(_merged, "run long, part int, counts binary")
    return runs.groupBy("run").cogroup(counted.groupBy("run")).applyInArrow(
        _answered(radix), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, documents, best): every linked id pair, the documents that hold it, and whether it is the most frequent of its A id."""
    runs = write_runs(docs, path_a, path_b, id_col, text)
    radix = min(max(runs.count(), LEAST_RADIX), MOST_RADIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["part"] not in held:
                    yield from table(held.popitem()[1])
                held.setdefault(r["part"], []).append(r)
        if held:
            yield from table(held.popitem()[1])

    def table(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        spills = [(_sorted_unpack(r["pairs"]), _unpack(r["holders"], "<u4")) for r in rows]
        codes, first = np.unique(np.concatenate([c for c, _ in spills]), return_index=True)
        value = np.concatenate(merge_runs(spills))[first]
        yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(value >> 1), pa.array(value & 1 == 1)],
                                         names=["a", "b", "documents", "best"])

    spills = runs.select("run", "pairs", "holders").mapInArrow(_spilled(radix), "part int, run long, pairs binary, holders binary")
    return spills.repartition("part").sortWithinPartitions("part", "run").mapInArrow(run, "a long, b long, documents long, best boolean")

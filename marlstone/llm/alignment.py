"""Alignment of two tokenizers over whole texts: overlaps by an interval index, groups at gaps that no token spans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, materialise, small_batches

#: Folder of the vocabulary files, and the two files that are compared.
FOLDER, BYTE_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary cuts a text before it merges bytes.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text and documents that one cell holds (a longer text is a cell of its own): pairs are counted once for each cell.
CELL_BYTES, CELL_ROWS = 8 << 20, 60_000


class Spelling:
    """What each token id spells, as one byte array, and its id as decimal digits followed by each of two marks."""

    def __init__(self, tokens: list[bytes], marks: str):
        self.flat, self.at = _flat(tokens)
        self.size = np.diff(self.at)
        self.names, self.name_at = _flat([f"{i}{m}".encode() for m in marks for i in range(len(tokens))])
        self.n = len(tokens)


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices (start, size) of a byte array, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_level(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


def byte_ranks(raw: bytes) -> dict[bytes, int]:
    """Bytes and id of each token of a byte-level vocabulary file, whose ids must follow the order of its merges."""
    model = json.loads(raw)["model"]
    # printable bytes stand for themselves, the others for the code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    for k, m in enumerate(model["merges"]):
        if model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] != 256 + k:
            raise ValueError("ids of the byte-level vocabulary do not follow its merges")
    return {_byte_level(t, table): i for t, i in model["vocab"].items()}


@dataclass
class Tokenizers:
    """Both vocabularies as the bytes of their files (some MB, whatever the corpus), loaded once in each task."""

    byte_file: bytes
    piece_file: bytes

    @staticmethod
    def read(folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> Tokenizers:
        with open(f"{folder}/{byte_file}", "rb") as a, open(f"{folder}/{piece_file}", "rb") as b:
            return Tokenizers(a.read(), b.read())

    def load(self) -> None:
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(self.byte_file)
        self.first = tiktoken.Encoding("first", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=self.piece_file)
        spelled = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            spelled[i] = t
        self.a = Spelling(spelled, ",|")
        s = self.second
        pieces = [(i, s.id_to_piece(i)) for i in range(s.get_piece_size())]
        self.b = Spelling([bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces], ",;")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text with a space before it; the second vocabulary adds that space itself."""
        first = [self.first.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
        return first, [np.array(x, np.int64) for x in self.second.encode(texts, num_threads=1)]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last b token that each a token overlaps: both tile the same bytes, so starts and ends are sorted and bisected."""
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    return np.searchsorted(start_b, start_a, "right") - 1, np.searchsorted(start_b, end_a, "left") - 1


@dataclass
class Aligned:
    """One stream of texts whose tokens spell the same bytes in both vocabularies."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align_stream(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    lo, hi = overlaps(np.cumsum(size_a), np.cumsum(size_b))
    # gap j lies after b token j; an a token over lo..hi spans the gaps lo..hi-1
    n = len(b)
    spanned = np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n)) > 0
    group_b = np.concatenate([[0], np.cumsum(~spanned[:-1])])
    count = hi - lo + 1
    link_a = np.repeat(np.arange(len(a)), count)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(count) - count - lo, count)
    return Aligned(a, b, group_b[lo], group_b, link_a, link_b)


def group_texts(x: Aligned, va: Spelling, vb: Spelling, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: the tokens of one stream in the order of their groups, written as ids and marks."""
    last = lambda g: np.concatenate([g[1:] != g[:-1], [True]])
    by_a, by_b = np.bincount(x.group_a), np.bincount(x.group_b)
    total = len(x.a) + len(x.b)
    token, names, starts = np.empty(total, np.int64), np.concatenate([va.names, vb.names]), np.concatenate([va.name_at[:-1], vb.name_at[:-1] + va.name_at[-1]])
    token[np.arange(len(x.a)) + (np.cumsum(by_b) - by_b)[x.group_a]] = x.a + va.n * last(x.group_a)
    token[np.arange(len(x.b)) + np.cumsum(by_a)[x.group_b]] = x.b + vb.n * last(x.group_b) + 2 * va.n
    size = np.concatenate([np.diff(va.name_at), np.diff(vb.name_at)])[token]
    text = _gather(names, starts[token], size).tobytes()
    ends = np.cumsum(size)[np.cumsum(n_a + n_b) - 1]
    return [text[s : e - 1] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Cell:
    """Documents of one cell: their own columns, and which of them link which pairs how often."""

    def __init__(self):
        self.rows, self.keys, self.times, self.bytes = [], [], [], 0

    def add(self, ids: list, texts: list[str | None], tok: Tokenizers) -> None:
        first_row = len(self.rows)
        self.rows += [(i, 0, 0, 0, 0, "") for i in ids]
        some = [k for k, t in enumerate(texts) if isinstance(t, str) and t]
        self.bytes += sum(len(texts[k]) for k in some) + len(texts)
        first, second = tok.encode([texts[k] for k in some])
        raw = [(" " + texts[k]).encode() for k in some]
        same = self._spell(first, tok.a, raw) & self._spell(second, tok.b, raw)
        good = np.flatnonzero(same)
        if not len(good):
            return
        first, second = [first[k] for k in good], [second[k] for k in good]
        n_a, n_b = np.array([len(x) for x in first]), np.array([len(x) for x in second])
        a, b = _joined(first), _joined(second)
        x = align_stream(a, b, tok.a.size[a], tok.b.size[b])
        doc_b = np.repeat(np.arange(len(good)), n_b)
        doc_link = doc_b[x.link_b]
        n_groups = np.bincount(doc_b[np.concatenate([[True], x.group_b[1:] != x.group_b[:-1]])], minlength=len(good))
        n_links = np.bincount(doc_link, minlength=len(good))
        for k, t in enumerate(group_texts(x, tok.a, tok.b, n_a, n_b)):
            row = first_row + some[good[k]]
            self.rows[row] = (self.rows[row][0], int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(t).hexdigest())
        at = first_row + np.array(some)[good]
        key, times = np.unique(((x.a[x.link_a] << 16 | x.b[x.link_b]) << 16 | at[doc_link]).astype(np.uint64), return_counts=True)
        self.keys.append(key)
        self.times.append(times)

    @staticmethod
    def _spell(ids: list[np.ndarray], v: Spelling, raw: list[bytes]) -> np.ndarray:
        """Which texts the tokens spell byte by byte."""
        flat = _joined(ids)
        got = _gather(v.flat, v.at[flat], v.size[flat]).tobytes()
        size = [int(v.size[x].sum()) for x in ids]
        at = np.concatenate([[0], np.cumsum(size)]).astype(int).tolist()
        return np.array([got[s:e] == r for s, e, r in zip(at, at[1:], raw)], bool)

    def close(self, cell: int) -> dict:
        """One row: columns of the documents, distinct pairs with the number of documents that link them, and those documents packed."""
        key = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        times = np.concatenate(self.times) if self.times else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")  # texts of one cell share no keys
        pairs, docs = np.unique(key[order] >> np.uint64(16), return_counts=True)
        pack = zstandard.ZstdCompressor(level=1).compress
        columns = list(zip(*self.rows)) or [[]] * 6
        out = dict(zip(("ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), ([list(c)] for c in columns)))
        return out | {
            "cell": [cell], "pairs": [pairs.astype(np.int64)], "docs": [docs.astype(np.int64)],
            "who": [pack((key[order] & np.uint64(0xFFFF)).astype(np.uint16).tobytes())], "times": [pack(times[order].astype(np.uint32).tobytes())],
        }


_CELL = "cell long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<long>, who binary, times binary"
_OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def cells(df: DataFrame, id_col: str, text_col: str, tokenizers: Tokenizers) -> DataFrame:
    """Rows of :meth:`Cell.close` over all rows of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizers)
    most, rows = CELL_BYTES, CELL_ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizers(shared.value.byte_file, shared.value.piece_file)
        tok.load()
        part, n, cell = TaskContext.get().partitionId(), 0, Cell()
        for pdf in batches:
            for some in chunks(pdf, "text"):
                for s in range(0, len(some), rows):
                    ids, texts = some["id"].iloc[s : s + rows].tolist(), some["text"].iloc[s : s + rows].tolist()
                    if cell.rows and (cell.bytes + sum(len(t) for t in texts if isinstance(t, str)) > most or len(cell.rows) + len(ids) > rows):
                        yield pd.DataFrame(cell.close(part << 33 | n))
                        n, cell = n + 1, Cell()
                    cell.add(ids, texts, tok)
        if cell.rows:
            yield pd.DataFrame(cell.close(part << 33 | n))

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    whole = df.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.col(text_col).alias("text"))
    flat = whole.select(F.to_json("id", {"ignoreNullFields": "false"}).alias("id"), "text")
    got = flat.mapInPandas(run, f"ids array<string>, {_CELL}")
    return got.withColumn("ids", F.transform("ids", lambda j: F.from_json(j, f"id {kind}")["id"]))


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, v) from (cell, pair, docs): documents that link the pair, doubled, and one more if no pair of its first id has more.

    Counts are summed within tasks before they move. A first id has at most as many pairs as the second vocabulary has ids,
    and the table of best counts has one row for each first id (65,536 at most), whatever the corpus.
    """
    counts = materialise(parts.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("first", F.shiftright("pair", 16)))
    top = counts.groupBy("first").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "first").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("top")).cast("long")).alias("v"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: Tokenizers | None = None) -> DataFrame:
    """One row for each row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first vocabulary encodes a space and the text, the second the text; neither makes special tokens. A text that is
    null or empty, or that either's tokens do not spell byte by byte, has no tokens: zeros and an empty text. Texts are
    encoded once and whole. Documents of one task form cells; a cell sends each of its distinct pairs once, with the number
    of documents that link it, and gets the corpus-wide count back once, so neither texts nor tokens move. Null and repeated
    ids keep their rows; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    table = materialise(cells(df, id_col, text_col, tokenizers or Tokenizers.read()))
    parts = table.select("cell", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("cell", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    found = parts.select("cell", "pair").join(pair_counts(parts), "pair").groupBy("cell").agg(F.collect_list("pair").alias("pair"), F.collect_list("v").alias("v"))
    slim = table.select("cell", "docs", "who", "times", F.size("ids").alias("n")).join(found, "cell")
    scores = slim.mapInArrow(_score, "cell long, n_best array<long>, count_sum array<long>")
    columns = [c.split()[0] for c in _OUT.split(", ")]
    whole = table.select("cell", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, "cell", "left")
    none = F.transform("ids", lambda _: F.lit(0).cast("long"))
    whole = whole.withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})
    return whole.select(F.explode(F.arrays_zip("ids", *columns)).alias("d")).select(F.col("d.ids").alias(id_col), *[F.col(f"d.{c}").alias(c) for c in columns])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each document of a cell, from the values of the cell's pairs."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            value = {c: batch.column(c)[k] for c in batch.schema.names}
            of = lambda c: value[c].values.to_numpy()
            v = of("v")[np.argsort(of("pair"))]
            who, times = (np.frombuffer(unpack(value[c].as_py()), t) for c, t in (("who", np.uint16), ("times", np.uint32)))
            v, n = np.repeat(v, of("docs")), value["n"].as_py()
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], who, times * (v & 1))
            np.add.at(sums[1], who, times * (v >> 1))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array([value["cell"].as_py()], pa.int64()), *lists], ["cell", "n_best", "count_sum"])

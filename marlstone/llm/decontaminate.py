"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, small_batches

WINDOW = 10
#: Words of test items held by one automaton (some 90 MB in a Python worker); a larger benchmark is taken in blocks of items, one after another.
BLOCK_WORDS = 100_000
#: A document with a larger share of hit words is dropped whole by :func:`remove_spans`.
MAX_COVERAGE = 0.5
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if isinstance(text, str) else []


class Automaton:
    """Generalised suffix automaton of item word sequences; states know which items' windows end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # windows: walk each item again and mark, at each window's end, the state that holds exactly that window
        self.ends: list[dict[int, set[str]]] = [{} for _ in self.next]
        self.shortest = window
        for item, seq in ids:
            size = min(window, len(seq))
            self.shortest = min(self.shortest, size)
            s = n = 0
            for k, c in enumerate(seq):
                s, n = self.next[s][c], n + 1
                while self.length[self.link[s]] >= size:
                    s = self.link[s]
                n = min(n, size)
                if k + 1 >= size:
                    self.ends[s].setdefault(size, set()).add(item)
        # nearest state on the suffix-link path, itself included, that has a window
        self.near = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.near[s] = s if self.ends[s] else self.near[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        link[q] = k
        return k

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged spans of hit words, items with an occurring window, longest match."""
        get = self.vocab.get
        ids = [get(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        nxt, link, length, near, ends = self.next, self.link, self.length, self.near, self.ends
        s = n = best = 0
        for i, c in enumerate(ids):
            if c < 0:
                s = n = 0
                continue
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            else:
                n = 0
                continue
            if n < self.shortest:
                continue
            if n > best:
                best = n
            t = near[s]
            while t > 0:
                for size, who in ends[t].items():
                    if size <= n:
                        a = i + 1 - size
                        while spans and spans[-1][1] >= a and spans[-1][0] >= a:
                            spans.pop()
                        if spans and spans[-1][1] >= a:
                            spans[-1] = (spans[-1][0], i + 1)
                        else:
                            spans.append((a, i + 1))
                        items |= who
                t = near[link[t]]
        return spans, items, best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The stated test set in blocks of bounded size, streamed to the driver one partition at a time; ids as strings."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 2 + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


_HITS = "n_words long, spans array<struct<s:int,e:int>>, items array<string>, longest int, rest string"
#: The automaton that this Python worker built last: tasks of one query share it.
_BUILT: dict[str, Automaton] = {}


def _scanner(block: list[tuple[str, str]], spark, window: int):
    shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    @F.pandas_udf(_HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Automaton([(i, [w for w in normal_words(t) if w]) for i, t in shared.value], window)
        auto = _BUILT[name]
        for s in batches:
            rows = []
            for t in s:
                words = [w for w in normal_words(t) if w]
                spans, items, best = auto.scan(words) if words else ([], (), 0)
                rows.append((len(words), [{"s": a, "e": b} for a, b in spans], sorted(items), best, without(t, spans) if spans else None))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest", "rest"])

    return scan.asNondeterministic()  # so that a filter on the hits does not scan the texts once more


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``df`` with the struct column ``hits``: n_words, spans (word index, end exclusive), items (ids as strings), longest, rest.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer; words inside any occurrence
    are hit; ``rest`` is the text without them, null where none is hit. Null and empty texts have no words; items with a
    null id or text and items without words have no windows; ids may be of any type; repeated items and rows do no harm;
    other columns pass through whatever their names (a column ``hits`` is replaced); an empty benchmark hits nothing.
    Texts are streamed whole through the automaton in one pass; a benchmark of several blocks takes one pass for each,
    with one automaton in memory at a time, and the passes' hits are united by row.
    """
    spark = df.sparkSession
    small_batches(spark)
    names = [c for c in df.columns if c != "hits"]
    blocks = list(_blocks(benchmark, item_id, item_text))
    if len(blocks) == 1:
        return df.select(*[df[c] for c in names], _scanner(blocks[0], spark, window)(df[text_col]).alias("hits"))
    rows = materialise(df.select(F.struct(*[df[c] for c in names]).alias("row"), df[text_col].alias("text")).withColumn("key", F.monotonically_increasing_id()))
    found = None
    for block in blocks:
        one = materialise(rows.select("key", _scanner(block, spark, window)(F.col("text")).alias("h")).where("size(h.spans) > 0").select("key", "h.spans", "h.items", "h.longest"))
        found = one if found is None else found.unionByName(one)
    every = found.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    every = every.withColumn("spans", merged)

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(x["s"], x["e"]) for x in s]) if s is not None else None for t, s in zip(text, spans)], dtype=object)

    got = rows.join(every, "key", "left")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hits = F.struct(
        n_words.alias("n_words"), F.coalesce("spans", none("struct<s:int,e:int>")).alias("spans"), F.coalesce("items", none("string")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"),
        F.when(F.col("spans").isNotNull(), rest(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))).alias("rest"),
    )
    return got.select(hits.alias("hits"), "row").select("row.*", "hits")


def remove_spans(df: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Apply ``hits``: rows whose hit share exceeds ``max_coverage`` go, the hit words of the others are cut out of the text.

    Texts without a hit stay as they are, nulls included; repeated rows and other columns pass through; ``hits`` stays.
    """
    n_hit = F.aggregate("hits.spans", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    kept = df.where((F.col("hits.n_words") == 0) | (n_hit <= F.col("hits.n_words") * max_coverage))
    return kept.withColumn(text_col, F.when(F.col("hits.rest").isNotNull(), F.col("hits.rest")).otherwise(F.col(text_col)))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    at, pos = [], 0
    for w in raw.translate(_TABLE).split(b" "):
        if w:
            at.append((pos, pos + len(w)))
        pos += len(w) + 1
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")

"""Exact substring deduplication over a sparse suffix array.

Every window of ``length`` bytes has one anchor: the start of the 32-byte gram with the smallest hash in it, leftmost among
equals. Equal windows have their anchor at the same offset, so only suffixes at anchors need to meet. An anchor stands for
the run of windows that share it; the bytes of that run are its context.

1. Anchors of all texts, as (gram hash, digest of the context, row, place), written once: no text is shuffled.
2. Grams seen once cannot repeat. Of the others two representatives of each distinct context (one if it stands alone) fetch
   their bytes.
3. These suffixes are range-partitioned by sampled splitters on their leading bytes; each bucket sorts its suffixes by
   multikey quicksort, drops those whose longest common prefix with both neighbours is too short, and compares the windows
   of the others by their bytes. Hashes pick what meets, bytes decide; further copies of a context whose two representatives
   agree follow by its 128-bit digest.
4. A gram with more than GROUP distinct contexts lies in several buckets: its windows meet across their boundaries by digest.
5. Spans go back to their rows, where they are united and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, bounds, materialise, partitions, small_batches

LENGTH = 200
GRAM = 32
#: Bytes handled at once within a task; a longer text is handled in pieces that overlap by a window less one byte.
STEP = 1 << 19
#: Distinct contexts of one gram that meet in one task; a larger group is dealt over several buckets.
GROUP = 20_000
_POS = np.uint64((1 << 28) - 1)


def _raw(t: str | None) -> bytes:
    return t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def anchors(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one byte array that share an anchor: anchor, first and last window start, and the gram hashes.

    ``ends`` gives for every byte the end of its text; windows never cross it.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    h = Rolling.of_bytes(buf).slices(at, at + gram)
    w = length - gram + 1
    key = (h & ~_POS) | at.astype(np.uint64)
    pad = -len(key) % w
    k2 = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    head = np.minimum.accumulate(k2, axis=1).ravel()
    tail = np.minimum.accumulate(k2[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    low = np.minimum(tail[:m], head[w - 1 : w - 1 + m])
    start = np.arange(m)
    ok = start + length <= ends[:m]
    start, a = start[ok], (low[ok] & _POS).astype(np.int64)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    s, e = bounds(a)
    return a[s], start[s], start[e - 1], h[a[s]]


def _batches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces as one array: the text of each piece, its offset there, the array, the starts, and each byte's end of piece."""
    pieces = [(i, o, t[o : o + STEP + length - 1]) for i, t in enumerate(texts) for o in range(0, max(len(t) - length + 1, 0), STEP)]
    k = 0
    while k < len(pieces):
        j, size = k, 0
        while j < len(pieces) and (j == k or size + len(pieces[j][2]) <= STEP):
            size += len(pieces[j][2])
            j += 1
        some = pieces[k:j]
        sizes = np.array([len(x[2]) for x in some], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        yield np.array([x[0] for x in some]), np.array([x[1] for x in some]), np.frombuffer(b"".join(x[2] for x in some), np.uint8), at, np.repeat(at[1:], sizes)
        k = j


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rid = b["rid"].to_numpy()
            for idx, offset, buf, at, ends in _batches([_raw(t) for t in b["text"]], length):
                a, lo, hi, h = anchors(buf, ends, length, gram)
                if not len(a):
                    continue
                which = np.searchsorted(at, a, side="right") - 1
                # the digest covers the whole run of windows and the anchor's place in it
                raw, digest = buf.tobytes(), hashlib.blake2b
                ch = [digest(raw[s : e + length], digest_size=16, salt=o.to_bytes(2, "little")).digest() for s, e, o in zip(lo.tolist(), hi.tolist(), (a - lo).tolist())]
                place = ((lo - at[which] + offset[which]) << 24) | ((hi - lo) << 12) | (a - lo)
                yield pd.DataFrame({"kh": h.view(np.int64), "ch": ch, "rid": rid[idx[which]], "place": place})

    return run


def multikey_sort(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and the longest common prefix of each with the one before (first: 0).

    Multikey quicksort with keys of eight bytes: a group of suffixes that agree so far is split by its next eight bytes,
    groups of one are done; a suffix that ends sorts before one that goes on.
    """
    n = len(suffixes)
    width = max((len(s) for s in suffixes), default=0) // 8 + 1
    flat = np.zeros((n, width * 8), np.uint8)
    size = np.array([len(s) for s in suffixes], np.int64)
    col = np.arange(width * 8)
    flat[col[None, :] < size[:, None]] = np.frombuffer(b"".join(suffixes), np.uint8)
    words = flat.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.ones(n, bool)
    for k in range(width + 1):
        at = np.flatnonzero(live)
        if not len(at):
            break
        key = words[order[at], k] if k < width else size[order[at]].astype(np.uint64)
        o = np.lexsort((key, group[at]))
        order[at] = order[at][o]
        key, g = key[o], group[at]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        live[at] = ~(new & np.append(new[1:], True))
    lcp = np.zeros(n, np.int64)
    if n > 1:
        same = flat[order[1:]] == flat[order[:-1]]
        run = np.where(same.all(axis=1), width * 8, same.argmin(axis=1))
        lcp[1:] = np.minimum(run, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, lcp


def _equal_windows(buf: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Class number of each window: equal windows, and only they, share it (hashes first, bytes decide)."""
    h = Rolling.of_bytes(buf).slices(pos, pos + length)
    order = np.argsort(h, kind="stable")
    p, k = pos[order], h[order]
    tie = np.flatnonzero(k[1:] == k[:-1]) + 1
    grid = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    same = np.ones(len(tie), bool)
    for step in [*range(0, length - 8, 8), length - 8]:
        same &= grid[p[tie] + step] == grid[p[tie - 1] + step]
    out = np.empty(len(pos), np.int64)
    if same.all():
        new = np.ones(len(pos), bool)
        new[tie] = False
        out[order] = np.cumsum(new)
    else:  # two different windows with one hash
        raw, names = buf.tobytes(), {}
        out[:] = [names.setdefault(raw[x : x + length], len(names)) for x in pos.tolist()]
    return out


def _solve(rows: pd.DataFrame, length: int, edge: np.ndarray) -> Iterator[pd.DataFrame]:
    """One bucket's groups of suffixes: spans of windows found twice, contexts whose two representatives agree (``whole``), and
    digests for groups that may go on in another bucket."""
    ctx = rows["ctx"].tolist()
    place = rows["place"].to_numpy()
    off, more, lo = place & 0xFFF, (place >> 12) & 0xFFF, place >> 24
    order, lcp = multikey_sort([c[o:] for c, o in zip(ctx, off.tolist())])
    # longest right match of each suffix; a window that starts d bytes before its anchor needs length - d of it
    reach = np.zeros(len(ctx), np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    least = np.where(edge, 0, length - reach)
    first, last = np.maximum(off - more, least), off  # d runs from first to last
    use = np.flatnonzero(first <= last)
    if not len(use):
        return
    buf = np.frombuffer(b"".join(ctx[i] for i in use), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(ctx[i]) for i in use])])[:-1]
    count = (last - first + 1)[use]
    owner = np.repeat(np.arange(len(use)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # window in its run, by falling d
    pos = base[owner] + j
    cls = _equal_windows(buf, pos, length)
    twice = np.bincount(cls)[cls] > 1
    who = use[owner]
    rid, n, kh, ch = (rows[c].to_numpy() for c in ("rid", "n", "kh", "ch"))
    pair = n[who] > 1
    want = twice & ~pair
    s = (lo[who] + j)[want]
    r = rid[who][want]
    none = {"digest": None, "known": False, "kh": None, "ch": None}
    if len(s):
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]))
        e = s[np.append(cut[1:], len(s)) - 1] + length
        yield pd.DataFrame({"rid": r[cut], "s": s[cut], "e": e} | none)
    # a context that stands twice or more: all of its windows must have been found twice
    found = np.bincount(owner, twice, minlength=len(use)).astype(np.int64)
    whole = use[(n[use] > 1) & (found == more[use] + 1)]
    if len(whole):
        yield pd.DataFrame({"rid": rid[whole], "s": 0, "e": 0} | none | {"kh": kh[whole], "ch": ch[whole]})
    at_edge = np.flatnonzero(edge[who])
    if len(at_edge):
        # single windows ask; of those found here already one of each class answers
        c = cls[at_edge]
        _, one = np.unique(c, return_index=True)
        first_of = np.zeros(len(at_edge), bool)
        first_of[one] = True
        known = twice[at_edge]
        send = at_edge[~known | first_of]
        raw = buf.tobytes()
        yield pd.DataFrame(
            {
                "rid": rid[who[send]],
                "s": (lo[who] + j)[send],
                "e": (lo[who] + j)[send] + length,
                "digest": [hashlib.blake2b(raw[x : x + length], digest_size=16).digest() for x in pos[send].tolist()],
                "known": twice[send],
                "kh": None,
                "ch": None,
            }
        )


def _buckets(length: int):
    """Rows arrive sorted by ``lead``; whole groups of one lead are handled together, some thousand rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def solve(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            yield from _solve(pdf, length, (pdf["slots"] > 1).to_numpy())

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size < 8192:
                continue
            pdf = pd.concat(held, ignore_index=True)
            tail = (pdf["lead"] == pdf["lead"].iloc[-1]).to_numpy()
            if not tail.all():
                yield from solve(pdf[~tail].reset_index(drop=True))
                held, size = [pdf[tail].reset_index(drop=True)], int(tail.sum())
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    return run


def duplicate_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans array<struct<s,e>>) for the rows of ``docs(rid long, text)`` with a repeated window; spans in bytes, unsorted."""
    spark = docs.sparkSession
    small_batches(spark)
    a = materialise(docs.mapInPandas(_anchor_rows(length, gram), "kh long, ch binary, rid long, place long"))
    grams = materialise(a.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh"))
    again = materialise(a.join(grams, "kh", "left_semi"))
    at = F.struct("rid", "place")
    kinds = materialise(again.groupBy("kh", "ch").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")))
    large = kinds.groupBy("kh").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("slots"))
    sized = kinds.join(large, "kh").withColumn("slot", F.pmod(F.xxhash64("ch"), F.col("slots")).cast("int"))
    reps = sized.select("kh", "ch", "n", "slot", "slots", F.explode(F.when(F.col("n") > 1, F.array("lo", "hi")).otherwise(F.array("lo"))).alias("x"))
    asked = reps.select("x.rid", F.struct("kh", "ch", "n", "slot", "slots", "x.place").alias("q")).groupBy("rid").agg(F.collect_list("q").alias("asks"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text, asks in zip(b["rid"], b["text"], b["asks"]):
                raw = _raw(text)
                for q in asks:
                    p = q["place"]
                    lo = p >> 24
                    ctx = raw[lo : lo + ((p >> 12) & 0xFFF) + length]
                    o = p & 0xFFF
                    out.append((ctx[o : o + gram], q["slot"], q["slots"], q["n"], q["kh"], q["ch"], rid, p, ctx))
            yield pd.DataFrame(out, columns=["lead", "slot", "slots", "n", "kh", "ch", "rid", "place", "ctx"])

    parts = docs.join(asked, "rid").select("rid", "text", "asks").mapInPandas(fetch, "lead binary, slot int, slots int, n long, kh long, ch binary, rid long, place long, ctx binary")
    suffixes = materialise(parts)
    ranged = suffixes.repartitionByRange(partitions(spark), "lead", "slot").sortWithinPartitions("lead")
    found = materialise(ranged.mapInPandas(_buckets(length), "rid long, s long, e long, digest binary, known boolean, kh long, ch binary"))
    at_edges = found.where("digest is not null")
    shared = at_edges.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest")
    across = at_edges.where("not known").join(shared, "digest").select("rid", F.struct("s", "e").alias("x"))
    own = found.where("digest is null and ch is null").select("rid", F.struct("s", "e").alias("x"))
    span = F.struct(F.shiftright("place", 24).alias("s"), (F.shiftright("place", 24) + F.shiftright("place", 12).bitwiseAND(F.lit(0xFFF)) + length).alias("e"))
    whole = again.join(found.where("ch is not null").select("kh", "ch"), ["kh", "ch"], "left_semi").select("rid", span.alias("x"))
    every = whole.unionByName(own).unionByName(across)
    return every.groupBy("rid").agg(F.collect_set("x").alias("spans"))


def united(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row of ``df``.

    Bytes covered by a ``length``-byte string that also starts elsewhere (same text included) are removed, judged on the
    input. Null and empty texts have no bytes; a repeated row is another text, so its bytes are found twice; a null id is
    an id; other columns are ignored, so clashing names do no harm; an empty table gives an empty result. Rows are told
    apart by a 64-bit hash of id and text. Spans may cut a character: ``kept`` is binary.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("id", "text"))
    spans = duplicate_spans(docs.select("rid", "text"), length)
    cut = F.pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    got = docs.join(spans, "rid", "left").select("id", cut("text", "spans").alias("c"))  # ids do not go to Python
    return got.select(F.col("id").alias(id_col), "c.*")


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans):
        raw = _raw(text)
        runs = united(found) if found is not None else []
        left, at = [], 0
        for s, e in runs:
            left.append(raw[at:s])
            at = e
        kept = b"".join([*left, raw[at:]])
        rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

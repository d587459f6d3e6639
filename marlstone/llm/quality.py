"""Quality rules from a suffix array: maximal repeated word runs, covered fraction, longest repeat, and plain counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import SPACES, bounds, chunks, exact_ids, joined, small_batches

#: Shortest repeat, in words, that counts as repetition.
MIN_REPEAT = 8
#: A text fails below this many words, or above this share (percent) of words in repeats.
MIN_WORDS, MAX_COVERED_PCT = 20, 30
#: A text fails if one repeat spans at least so many words and so large a share of it.
LONGEST_WORDS, LONGEST_SHARE = 64, 0.25
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True


def suffix_repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every position the longest prefix of its suffix that occurs elsewhere in the same group (0: none).

    Suffix array by prefix doubling over all groups at once: a rank is one more than the number of smaller suffixes, only
    tied ranks are sorted again, and a suffix that ends sorts first. The longest common prefix of array neighbours follows
    from the ranks kept at each power of two, longest power first.
    """
    n = len(value)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    s, e = bounds(group)
    end = np.repeat(e, e - s)
    key = group.astype(np.int64) * (int(value.max()) + 1) + value.astype(np.int64)
    order = np.argsort(key)
    rank, some = _refine(order, key[order], np.zeros(n, np.int64), None)
    ranks, live, width = [rank], some, 1
    while len(live):
        after = live + width
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)], 0)
        key = rank[live] * (n + 1) + second
        order = np.argsort(key)
        rank, live = _refine(live[order], key[order], rank, rank[live[order]])
        ranks.append(rank)
        width *= 2
    sa = some[np.argsort(rank[some])]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (x < end[a]) & (y < end[b])
        same &= ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)]
        lcp += same.astype(np.int64) << k
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _refine(pos: np.ndarray, key: np.ndarray, rank: np.ndarray, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of ``pos``, which are sorted by ``key`` within runs of the ``old`` rank, and those still tied."""
    i = np.arange(len(pos))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, i, 0))
    was = np.zeros(len(pos), np.int64)
    if old is not None:
        was = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), i, 0))
    out = rank.copy()
    out[pos] = (1 if old is None else old) + first - was
    tied = ~(new & np.append(new[1:], True))
    return out, pos[tied]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in the union of spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: pd.Series, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text; one pass over the bytes of all texts."""
    buf, at = joined(texts)
    m = len(texts)
    if m == 0:
        return {k: np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")}
    space = SPACES[buf]
    doc = lambda pos: np.searchsorted(at, pos, side="right") - 1
    per = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), at[:-1])
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    ws, we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    wdoc = doc(ws)
    out = {"n_words": np.bincount(wdoc, minlength=m)}
    out["word_chars"] = per(((buf & 0xC0) != 0x80) & ~space)
    out["n_symbols"] = per(_SYMBOL[buf])
    # lines: a newline follows every text, so each line ends at one
    le = np.flatnonzero(buf == 10)
    ls = np.concatenate([[0], le[:-1] + 1])
    full = np.add.reduceat(np.append(~space, 0).astype(np.int64), ls) > 0
    full &= le > ls
    ls, le = ls[full], le[full]
    ldoc, line = doc(ls), exact_ids(buf, ls, le)
    order = np.lexsort((line, ldoc))
    d, h = ldoc[order], line[order]
    again = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    out["n_dup_lines"] = np.bincount(d[1:][again], minlength=m)
    # repeats over words
    rep = suffix_repeats(wdoc, exact_ids(buf, ws, we))
    at_rep = np.flatnonzero(rep >= min_repeat)
    hit = covered(at_rep, at_rep + rep[at_rep], len(ws)) if len(ws) else np.zeros(0, bool)
    out["n_repeat_words"] = np.bincount(wdoc[hit], minlength=m)
    longest = np.zeros(m, np.int64)
    np.maximum.at(longest, wdoc, rep)
    out["longest_repeat"] = longest
    return out


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def quality_rules(df: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``df`` with the struct column ``quality``: the counts, base_failed, covered_fraction and kept.

    A text is kept unless it has under MIN_WORDS words, over MAX_COVERED_PCT percent of its words in repeats of
    ``min_repeat`` words or more, or one repeat of LONGEST_WORDS words or more that spans over LONGEST_SHARE of it.
    Null and empty texts have no words and fail; every row gives one row, repeated rows too; all other columns pass
    through whatever their names (a column ``quality`` is replaced); very long texts are handled whole, one at a time.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "quality"]
    count = _counter(min_repeat)  # only the text goes to Python
    q = F.col("quality")
    base = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_COVERED_PCT)
    long_one = (q["longest_repeat"] >= LONGEST_WORDS) & (q["longest_repeat"] > q["n_words"] * LONGEST_SHARE)
    got = df.select(*[df[c] for c in names], count(df[text_col]).alias("quality"))
    return got.withColumn(
        "quality",
        q.withField("base_failed", base)
        .withField("covered_fraction", F.when(q["n_words"] > 0, q["n_repeat_words"] / q["n_words"]).otherwise(F.lit(0.0)))
        .withField("kept", ~(base | long_one)),
    )


def _counter(min_repeat: int):
    @F.pandas_udf(OUT)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            pdf = pd.DataFrame({"text": s.to_numpy()})
            parts = [pd.DataFrame(measure(c["text"], min_repeat)) for c in chunks(pdf, "text")]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(measure(pdf["text"], min_repeat))

    return count.asNondeterministic()  # so that a filter on the counts does not take them once more

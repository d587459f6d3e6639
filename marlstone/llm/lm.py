"""Language-model scores: masked pseudo-likelihood of a bidirectional window network trained in numpy on the corpus.

Every word is predicted from the words on both its sides. Frequent words have ids of their own; all others share ids, and a
shared id's probability is divided among its cells by their counts in the corpus, so that probabilities sum to one over all
cells. Beside the network the model remembers contexts: where the same four neighbours stand elsewhere in the corpus, the
words seen between them there take part in the prediction. Both tables of counts are gathered from all texts.

Every place is looked up among all places. Texts are dealt into chunks; a chunk asks each range of context hashes (a bucket)
about its distinct pairs of context and word in one row, with their counts, and gets one row of counts back, in the same order.
So a context that stands very often costs one pair for each chunk and word, and a place costs about nine bytes of shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounds, chunks, discard, materialise, mix, small_batches, word_hashes

#: The most frequent words have ids of their own; all others share ids by the leading bits of their hashes.
KNOWN, SHARED = 960, 64
#: Bits of a word's hash that name its cell; a cell belongs to one shared id. The counts of all cells are 4 MB.
CELL_BITS = 20
CLASS = 32  # outputs are factored: class of an id (id // 32), then the id within its class
HALF, DIM = 2, 16
#: Rounds of averaged local descent; each takes every ROUNDS-th position of every text with another offset, so that every
#: position is learned from once, whatever their number.
ROUNDS = 1
BATCH, RATE = 8192, 1.5
#: A context is remembered if its hash falls in one of so many classes; 1: every context is.
CONTEXTS = 1
#: Characters of a chunk (one long text stays whole), and of a bucket's share of the corpus; a task counts one bucket at a time.
CHUNK, BUCKET = 1_000_000, 8_000_000
#: Bits of a word's hash that tell words of one context apart.
_TAG = 24
_BLOCK = 8192
VOCAB = KNOWN + SHARED
_OFFSETS = [o for o in range(-HALF, HALF + 1) if o]
_PLACES = np.random.default_rng(23).integers(1, 2**63, 2 * HALF).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class WindowNet:
    known: np.ndarray  # sorted hashes of the known words
    number: np.ndarray  # their ids
    cells: np.ndarray  # log-probability of each cell within its shared id
    params: np.ndarray  # one flat float32 array, viewed below

    SHAPES = (
        ("left_right", (2 * HALF, VOCAB + 1, DIM)), ("bias", (DIM,)), ("cls", (DIM, VOCAB // CLASS)), ("cls_bias", (VOCAB // CLASS,)),
        ("word", (VOCAB // CLASS, DIM, CLASS)), ("word_bias", (VOCAB // CLASS, CLASS)),
    )

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for _, s in cls.SHAPES)

    @classmethod
    def start(cls, top: list[tuple[int, int]], cells: np.ndarray, seed: int = 9) -> WindowNet:
        """Small random weights; output biases are the corpus's own log frequencies. ``top``: (hash, count); ``cells``: counts."""
        rng = np.random.default_rng(seed)
        known = np.array([h for h, _ in top], np.int64).view(np.uint64)
        order = np.argsort(known)
        each = cells.reshape(-1, SHARED) + 0.5  # cell c belongs to the shared id c % SHARED
        net = cls(known[order], order, np.log(each / each.sum(0)).astype(np.float32).ravel(), rng.normal(0, 0.1, cls.size()).astype(np.float32))
        counts = np.zeros(VOCAB)
        counts[: len(top)] = [n for _, n in top]
        counts[KNOWN:] = cells.reshape(-1, SHARED).sum(0)
        p = (counts + 1.0) / (counts + 1.0).sum()
        v = net.views()
        by = p.reshape(-1, CLASS)
        v["bias"][:] = 0
        v["cls_bias"][:] = np.log(by.sum(1))
        v["word_bias"][:] = np.log(by / by.sum(1, keepdims=True))
        return net

    def views(self) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            out[name] = self.params[at : at + n].reshape(shape)
            at += n
        return out

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of each word hash, and the log-probability of the word within its id."""
        cell = (words >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        out, inside = KNOWN + cell % SHARED, self.cells[cell]
        if len(self.known):
            k = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            hit = self.known[k] == words
            out[hit], inside[hit] = self.number[k[hit]], 0
        return out, inside

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hidden layer for the positions ``at`` of an id array; the word itself is masked."""
        table = self.views()["left_right"]
        h = table[0][padded[at + _OFFSETS[0]]]
        for k, o in enumerate(_OFFSETS[1:], 1):
            h += table[k][padded[at + o]]
        h += self.views()["bias"]
        return np.tanh(h, out=h)

    def log_prob(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the ids at the positions ``at``."""
        v = self.views()
        out = np.empty(len(at))
        for s in range(0, len(at), BATCH):
            a, y, cuts, order = _by_class(padded, at[s : s + BATCH])
            h = self.hidden(padded, a)
            z = h @ v["cls"] + v["cls_bias"]
            lp = np.minimum(z[np.arange(len(a)), y // CLASS], _MOST) - _lse(z)
            inner = y % CLASS
            for k in range(VOCAB // CLASS):
                i = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    z = h[i] @ v["word"][k] + v["word_bias"][k]
                    lp[i] += np.minimum(z[np.arange(len(z)), inner[i]], _MOST) - _lse(z)
            out[s + order] = lp
        return out

    def descend(self, padded: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss of the positions ``at``."""
        v = self.views()
        at, y, cuts, _ = _by_class(padded, at)  # a class is one slice of the batch
        n, inner = len(at), y % CLASS
        h = self.hidden(padded, at)
        p = _softmax(h @ v["cls"] + v["cls_bias"])
        p[np.arange(n), y // CLASS] -= 1
        gh = p @ v["cls"].T
        v["cls"] -= rate / n * (h.T @ p)
        v["cls_bias"] -= rate * p.mean(0)
        for k in range(VOCAB // CLASS):
            i = slice(cuts[k], cuts[k + 1])
            size = cuts[k + 1] - cuts[k]
            if size:
                p = _softmax(h[i] @ v["word"][k] + v["word_bias"][k])
                p[np.arange(size), inner[i]] -= 1
                gh[i] += p @ v["word"][k].T
                v["word"][k] -= rate / size * (h[i].T @ p)
                v["word_bias"][k] -= rate / size * p.sum(0)
        h *= h
        gh *= 1 - h
        v["bias"] -= rate * gh.mean(0)
        for k, o in enumerate(_OFFSETS):
            near = padded[at + o].astype(np.int16)
            order = np.argsort(near, kind="stable")
            t = near[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            g = np.add.reduceat(gh[order], first, axis=0)
            # a frequent word's row takes the mean of its gradients, damped for rare ones
            v["left_right"][k][t[first]] -= rate * g / (np.diff(np.append(first, n))[:, None].astype(np.float32) + np.float32(8))


def _by_class(padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The positions sorted by the class of their ids, those ids, where each class begins, and the order."""
    y = padded[at]
    c = (y // CLASS).astype(np.int16)
    order = np.argsort(c, kind="stable")
    return at[order], y[order], np.searchsorted(c[order], np.arange(VOCAB // CLASS + 1)), order


_ONES = np.ones(CLASS, np.float32)
#: Largest logit that is told apart from larger ones, so that no sum of exponentials overflows.
_MOST = np.float32(60)


def _lse(z: np.ndarray) -> np.ndarray:
    return np.log(np.exp(np.minimum(z, _MOST)) @ _ONES)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.minimum(z, _MOST, out=z), out=z)
    z /= (z @ _ONES)[:, None]
    return z


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    names, which = np.unique(h, return_inverse=True)
    return names, np.bincount(which, n, minlength=len(names)).astype(np.int64)


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word: hash, n) over all texts; counted within tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            for c in chunks(b, "text"):
                words, _ = word_hashes(c["text"].tolist())
                parts.append((words, np.ones(len(words), np.int64)))
                size += len(words)
            if size > 500_000:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > 250_000:
                    yield pd.DataFrame({"word": parts[0][0].view(np.int64), "n": parts[0][1]})
                    parts, size = [], 0
        if parts:
            names, n = _merged(parts)
            yield pd.DataFrame({"word": names.view(np.int64), "n": n})

    return df.select(F.col(text_col).alias("text")).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _placed(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word hashes of many texts, index of the text of each, its place in an array with edges around every text, and that array's length."""
    words, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c in chunks(pd.DataFrame({"text": texts}), "text", 1_000_000):
        some, first = word_hashes(c["text"].tolist())
        words.append(some)
        n.append(np.diff(first))
    words, who = np.concatenate(words), np.repeat(np.arange(len(texts)), np.concatenate(n))
    return words, who, np.arange(len(words)) + HALF * (2 * who + 1), len(words) + 2 * HALF * len(texts)


def _packed(net: WindowNet, texts: list) -> tuple[np.ndarray, ...]:
    """Ids of many texts as one array with the edge id between them: (array, positions of words, index of text, word hashes, log-probabilities within ids)."""
    words, who, at, size = _placed(texts)
    arr = np.full(size, VOCAB, np.int64)
    arr[at], inside = net.ids(words)
    return arr, at, who, words, inside


def fit(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> WindowNet:
    """Train on all texts: counts of all words first, then rounds in which every partition descends on its own texts from the
    same weights and the results are averaged by the number of positions, in two levels of sums.

    The driver holds the KNOWN most frequent words, the counts of the cells and the network's weights, whatever the input.
    Null, empty and word-free texts add nothing; repeated rows count as often as they stand; an empty table trains nothing.
    """
    spark = df.sparkSession
    small_batches(spark)
    counts = materialise(count_words(df, text_col))
    # the least power of two that at least KNOWN words reach: only words above it are candidates
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, have = 0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        least, have = r["step"], have + r["words"]
        if have >= KNOWN:
            break
    top = [(r["word"], r["n"]) for r in counts.where(F.col("n") >= 2**least).orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    cell = F.shiftrightunsigned("word", 64 - CELL_BITS).cast("int").alias("cell")
    known = spark.createDataFrame([(w,) for w, _ in top], "word long")
    rest = counts.join(F.broadcast(known), "word", "left_anti").groupBy(cell).agg(F.sum("n").alias("n"))
    # cells come to the driver as a few dense blocks
    dense = rest.groupBy(F.shiftright("cell", 14).alias("block")).applyInPandas(_dense, "block int, counts binary").collect()
    cells = np.zeros((1 << (CELL_BITS - 14), 1 << 14))
    for r in dense:
        cells[r["block"]] = np.frombuffer(r["counts"], np.float32)
    discard(counts)
    cells = cells.ravel()
    net = WindowNet.start(top, cells)
    texts = df.select(F.col(text_col).alias("text"))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        rows = texts.mapInPandas(_learner(shared, r, rounds), "block int, part int, n double, sums binary")
        level = rows.groupBy("block", (F.col("part") % 64).alias("part")).applyInPandas(_adder, "block int, part int, n double, sums binary")
        total = level.groupBy("block").applyInPandas(_adder, "block int, part int, n double, sums binary").collect()
        if not total or not total[0]["n"]:
            break
        flat = np.concatenate([np.frombuffer(x["sums"], np.float64) / x["n"] for x in sorted(total, key=lambda x: x["block"])])
        net = WindowNet(net.known, net.number, net.cells, flat.astype(np.float32))
        shared.unpersist()
    return net


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of 16384 neighbouring cells as one array."""
    out = np.zeros(1 << 14, np.float32)
    out[pdf["cell"].to_numpy() % (1 << 14)] = pdf["n"].to_numpy()
    return pd.DataFrame({"block": [pdf["cell"].iloc[0] >> 14], "counts": [out.tobytes()]}).astype({"block": "int32"})


def _adder(pdf: pd.DataFrame) -> pd.DataFrame:
    s = np.zeros(len(pdf["sums"].iloc[0]) // 8)
    for x in pdf["sums"]:
        s += np.frombuffer(x, np.float64)
    out = {"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [pdf["n"].sum()], "sums": [s.tobytes()]}
    return pd.DataFrame(out).astype({"block": "int32", "part": "int32"})


def _learner(shared, turn: int, stride: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        start = shared.value
        net = WindowNet(start.known, start.number, start.cells, start.params.copy())
        n = 0
        for b in batches:
            for c in chunks(b, "text", 1_000_000):
                arr, at, *_ = _packed(net, c["text"].tolist())
                use = at[turn::stride]
                use = use[np.random.default_rng(len(use)).permutation(len(use))]
                for s in range(0, len(use), BATCH):
                    net.descend(arr, use[s : s + BATCH], RATE)
                n += len(use)
        flat = net.params.astype(np.float64) * n
        part = TaskContext.get().partitionId()
        cuts = range(0, len(flat), _BLOCK)
        yield pd.DataFrame(
            {"block": np.arange(len(cuts), dtype="int32"), "part": np.full(len(cuts), part, "int32"), "n": float(n), "sums": [flat[s : s + _BLOCK].tobytes() for s in cuts]}
        )

    return run


def _pairs(words: np.ndarray, at: np.ndarray, size: int, contexts: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs (context, word) of the remembered places by ascending context: (contexts, tags of words, counts, the places, the pair of each place)."""
    around = np.zeros(size, np.uint64)
    around[at] = words
    ctx = mix(sum((around[at + o] * m for o, m in zip(_OFFSETS, _PLACES)), np.zeros(len(at), np.uint64)))
    kept = np.flatnonzero(ctx % np.uint64(contexts) == 0)
    ctx, tag = ctx[kept], (words[kept] & np.uint64((1 << _TAG) - 1)).astype(np.int64)
    order, first, _ = _ordered(ctx, tag)
    n = np.diff(np.append(first, len(order)))
    pair = np.empty(len(order), np.int64)
    pair[order] = np.repeat(np.arange(len(first)), n)
    return ctx[order[first]], tag[order[first]], n, kept, pair


def _ordered(ctx: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by context and tag, where each pair begins in it, and where each context begins among the pairs."""
    by = np.argsort(ctx)
    c = ctx[by]
    code = (np.cumsum(c != np.append(c[:1], c[:-1])) << _TAG) | tag[by]
    again = np.argsort(code)
    first, _ = bounds(code[again])
    return by[again], first, bounds(code[again][first] >> _TAG)[0]


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, byte by byte, so that those alike stand together for the shuffle's compression."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _values(raw: bytes, size: int) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :size] = got.T
    return out.view("<u8").ravel()


def _chunker(most: int):
    """Rows (chunk, size, key, texts): texts of about ``most`` characters together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for k, t in zip(b["key"].tolist(), b["text"].tolist()):
                more = len(t) if isinstance(t, str) else 0
                if texts and size + more > most:
                    yield pd.DataFrame({"chunk": [at], "size": [size], "key": [keys], "texts": [texts]})
                    at, keys, texts, size = at + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                size += more
        if texts:
            yield pd.DataFrame({"chunk": [at], "size": [size], "key": [keys], "texts": [texts]})

    return run


def _asker(bits: int, contexts: int):
    """Rows (bucket, chunk, ctx, tag, n) of the distinct pairs of each chunk; a bucket is the leading bits of a context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, texts in zip(b["chunk"], b["texts"]):
                words, _, at, size = _placed(list(texts))
                ctx, tag, n, *_ = _pairs(words, at, size, contexts)
                if not len(ctx):
                    continue
                to = (ctx >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                cuts = [slice(s, e) for s, e in zip(*bounds(to))]
                yield pd.DataFrame(
                    {"bucket": [to[i.start] for i in cuts], "chunk": chunk, "ctx": [_planes(ctx[i], 8) for i in cuts], "tag": [_planes(tag[i], 3) for i in cuts], "n": [_planes(n[i], 4) for i in cuts]}
                )

    return run


def _counter(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each row of a bucket, how often the contexts (m) and the pairs (same) it asks for stand in all rows."""
    ctx, tag, n = (np.concatenate([_values(x, size) for x in pdf[k]]).astype(t) for k, size, t in (("ctx", 8, np.uint64), ("tag", 3, np.int64), ("n", 4, np.int64)))
    order, first, lead = _ordered(ctx, tag)
    pairs = np.add.reduceat(n[order], first)
    all_of = np.repeat(np.add.reduceat(pairs, lead), np.diff(np.append(lead, len(first))))
    each = np.diff(np.append(first, len(order)))
    m, same = np.empty(len(ctx), np.int64), np.empty(len(ctx), np.int64)
    m[order], same[order] = np.repeat(all_of, each), np.repeat(pairs, each)
    cuts = np.cumsum([len(x) // 3 for x in pdf["tag"]])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy()} | {k: [_planes(x, 5) for x in np.split(v, cuts)] for k, v in (("m", m), ("same", same))})


def _scorer(shared, contexts: int):
    """Rows (key, n, lp) of the texts of a chunk, given the counts of its pairs; every word is scored."""

    def run(chunk: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        net, key, texts = shared.value, np.asarray(chunk["key"].iloc[0], np.int64), list(chunk["texts"].iloc[0])
        arr, at, who, words, inside = _packed(net, texts)
        lp = net.log_prob(arr, at) + inside
        *_, kept, pair = _pairs(words, at, len(arr), contexts)
        if len(kept):
            counts = counts.sort_values("bucket")
            m, same = (np.concatenate([_values(x, 5) for x in counts[k]])[pair].astype(float) for k in ("m", "same"))
            with np.errstate(divide="ignore"):
                lp[kept] = np.logaddexp(lp[kept], np.log(same - 1)) - np.log(m)
        return pd.DataFrame({"key": key, "n": np.bincount(who, minlength=len(key)), "lp": np.bincount(who, lp, minlength=len(key))})

    return run


def score(df: DataFrame, net: WindowNet, text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """``df`` with the struct ``lm``: n_tokens, log_prob (sum over all tokens, each predicted from both sides) and mean_log_prob.

    A context that stands k times elsewhere in ``df`` predicts with weight k / (k + 1) by the share of those places that hold
    the same word, the network with the rest; with ``contexts`` above 1 only those of one class of hashes do. Null, empty and
    word-free texts have no tokens, log_prob 0 and a null mean. Other columns pass through whatever their names (``lm`` is
    replaced); repeated rows score alike, and each is an occurrence of its contexts; an empty table gives an empty result; long
    texts are whole. Texts and contexts are told apart by a 64-bit hash, words of one context by 24 bits.
    """
    spark = df.sparkSession
    small_batches(spark)
    names = [c for c in df.columns if c != "lm"]
    shared = spark.sparkContext.broadcast(net)
    key = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    texts = materialise(df.select(key(df[text_col]).alias("key"), df[text_col].alias("text")).mapInPandas(_chunker(CHUNK), "chunk long, size long, key array<long>, texts array<string>"))
    bits = ((texts.agg(F.sum("size")).first()[0] or 0) // BUCKET).bit_length()
    asked = texts.select("chunk", "texts").mapInPandas(_asker(bits, contexts), "bucket long, chunk long, ctx binary, tag binary, n binary")
    counts = materialise(asked.groupBy("bucket").applyInPandas(_counter, "chunk long, bucket long, m binary, same binary"))
    scored = texts.drop("size").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(_scorer(shared, contexts), "key long, n long, lp double")
    rows = materialise(scored)
    discard(texts, counts)
    total = rows.groupBy(F.col("key").alias("_key")).agg(F.max("n").alias("_n"), F.avg("lp").alias("_lp"))
    mean = F.when(F.col("_n") > 0, F.col("_lp") / F.col("_n"))
    out = df.select(F.struct(*[df[c] for c in names]).alias("_row"), key(df[text_col]).alias("_key")).join(total, "_key")
    return out.select("_row.*", F.struct(F.col("_n").alias("n_tokens"), F.col("_lp").alias("log_prob"), mean.alias("mean_log_prob")).alias("lm"))

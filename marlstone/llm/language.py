"""Language identification by a byte convolutional network: multi-width filters, max pooling and softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
#: Labelled rows that the network is fitted on at most; whole texts are cut into rows of FIT_CHARS characters, each labelled with its text's language.
FIT_ROWS, FIT_CHARS = 4_000, 1_024
EPOCHS, STEP, RATE = 6, 128, 0.01
UNKNOWN = "und"
_LETTER = r"\p{L}"


@dataclass
class ByteNet:
    labels: list[str]
    emb: np.ndarray  # (256, EMBED)
    conv: list[np.ndarray]  # (width, EMBED, FILTERS)
    bias: np.ndarray  # (3 * FILTERS,)
    out: np.ndarray  # (3 * FILTERS, labels)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, want_place: bool = False):
        """Max-pooled filter responses of windows x (n, WINDOW) of bytes; zero bytes pad."""
        n, length = x.shape
        # one table for each place of each filter: response = sum of table rows of the bytes it covers
        feats, places = [], []
        for w, kernel in zip(WIDTHS, self.conv):
            size = length - w + 1
            total = None
            for j in range(w):
                table = self.emb @ kernel[j]
                part = table[x[:, j : j + size]]
                total = part if total is None else np.add(total, part, out=total)
            if want_place:
                p = total.argmax(axis=1)
                places.append(p)
                feats.append(np.take_along_axis(total, p[:, None, :], 1)[:, 0, :])
            else:
                feats.append(total.max(axis=1))
        f = np.maximum(np.concatenate(feats, axis=1) + self.bias, 0)
        return (f, places) if want_place else f

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as consecutive windows, the last padded with zeros."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def train(texts: list[str], langs: list[str], seed: int = 3) -> ByteNet:
    """Adam on cross-entropy over all windows of the given texts."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    index = {c: i for i, c in enumerate(labels)}
    parts = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
    x = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)
    y = np.repeat([index[c] for c in langs], [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    k = len(labels)
    f = FILTERS * len(WIDTHS)
    net = ByteNet(
        labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), [rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(f, np.float32), rng.normal(0, 0.2, (f, k)).astype(np.float32), np.zeros(k, np.float32),
    )
    if k < 2:
        return net
    weights = [net.emb, *net.conv, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    # rare languages weigh as much as frequent ones
    balance = (len(y) / (k * np.bincount(y, minlength=k))).astype(np.float32)
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(x), STEP):
            b = order[s : s + STEP]
            xb, yb = x[b], y[b]
            h, places = net.pooled(xb, True)
            z = h @ net.out + net.out_bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), yb] -= 1
            p *= (balance[yb] / len(b))[:, None]
            gh = (p @ net.out.T) * (h > 0)
            g_emb = np.zeros_like(net.emb)
            g_conv = []
            rows = np.arange(len(b))[:, None]
            for q, (w, place) in enumerate(zip(WIDTHS, places)):
                g = gh[:, q * FILTERS : (q + 1) * FILTERS]
                gk = np.zeros_like(net.conv[q])
                for j in range(w):
                    c = xb[rows, place + j]  # the byte under place j of each filter
                    e = net.emb[c]
                    gk[j] = np.einsum("nfe,nf->ef", e, g)
                    np.add.at(g_emb, c, g[:, :, None] * net.conv[q][j].T[None])
                g_conv.append(gk)
            t += 1
            for w_, g_, m_, v_ in zip(weights, [g_emb, *g_conv, gh.sum(0), h.T @ p, p.sum(0)], m, v):
                m_ += 0.1 * (g_ - m_)
                v_ += 0.001 * (g_ * g_ - v_)
                w_ -= RATE * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.999**t)) + 1e-8)
    return net


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> ByteNet:
    """Fit on about ``rows`` labelled rows: pieces of FIT_CHARS characters of distinct texts, whole texts taken.

    Copies of a text count once for each language, and every language gives its first pieces by a hash of text and place, up
    to an equal share of ``rows`` (one at least) and of what smaller languages leave. Rows with a null language or without a
    letter are not used; an empty table gives a network without labels.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(_LETTER)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    keyed = usable.select(F.xxhash64("t", F.lit(5)).alias("h"), "l", F.ceil(F.length("t") / FIT_CHARS).cast("int").alias("pieces"), "t")
    sizes = {r["l"]: r["n"] for r in keyed.select("h", "l", "pieces").distinct().groupBy("l").agg(F.sum("pieces").alias("n")).collect()}
    if not sizes:
        return train([], [])
    left, most = rows, {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):  # small languages leave their rest to larger ones
        most[lang] = min(n, max(1, left // (len(sizes) - i)))
        left -= most[lang]
    # a hash filter of each language leaves about twice the pieces wanted, at least 40: then none is lost but by the ranks below
    steps = labelled.sparkSession.createDataFrame([(k, max(1, n // (2 * max(most[k], 20))), most[k]) for k, n in sizes.items()], "l string, step long, most long")
    pieces = keyed.join(F.broadcast(steps), "l").withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.pmod(F.xxhash64("h", i), F.col("step")) == 0)))
    few = pieces.select(F.xxhash64("h", "i").alias("h"), "l", "most", F.substring("t", F.col("i") * FIT_CHARS + 1, F.lit(FIT_CHARS)).alias("t")).dropDuplicates(["h", "l"])
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    picked = few.withColumn("rank", rank).where("rank <= most").select("h", "l", "t").orderBy("h", "l").collect()
    return train([r["t"] for r in picked], [r["l"] for r in picked])


def identify_language(df: DataFrame, net: ByteNet, text_col: str = "text") -> DataFrame:
    """``df`` with the struct ``language``: pred and score.

    The whole text is cut into windows of WINDOW bytes; their log-probabilities are averaged by their bytes. Texts that are
    null or have no letter are ``und`` with score 0; so is everything if no language was learned. Other columns pass
    through whatever their names (``language`` is replaced) and are never inputs; repeated rows get equal results; an
    empty table gives an empty result; a very long text is handled in blocks of windows.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "language"]
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in batches:
            pred, score = [UNKNOWN] * len(s), np.zeros(len(s))
            held, who, weight = [], [], []

            def flush() -> None:
                if not held:
                    return
                x = np.concatenate(held)
                owner, w = np.concatenate(who), np.concatenate(weight)
                logs = np.concatenate([model.log_probs(x[i : i + 256]) for i in range(0, len(x), 256)])
                sums = np.zeros((len(s), len(model.labels)))
                np.add.at(sums, owner, logs * w[:, None])
                total = np.bincount(owner, w, minlength=len(s))
                for i in np.unique(owner):
                    z = sums[i] / total[i]
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    pred[i], score[i] = model.labels[int(p.argmax())], float(p.max())
                held.clear(), who.clear(), weight.clear()

            for i, t in enumerate(s):
                if not isinstance(t, str) or not model.labels or not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                x = windows(raw)
                size = np.full(len(x), WINDOW, float)
                size[-1] = len(raw) - WINDOW * (len(x) - 1)
                held.append(x)
                who.append(np.full(len(x), i))
                weight.append(size)
                if sum(map(len, held)) > 20_000:
                    flush()
            flush()
            yield pd.DataFrame({"pred": pred, "score": score})

    lettered = F.when(F.col(text_col).rlike(_LETTER), F.col(text_col))
    return df.select(*[df[c] for c in names], run(lettered).alias("language"))

import hashlib
from collections import Counter, defaultdict

import pytest
from marlstone.llm import alignment
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n_a string, cell int"


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_FILE}")
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_FILE}")


def spelled(first, second):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a = lambda i: bytes(table[c] for c in first.id_to_token(i))
    b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    return a, b


def brute(texts, vocabularies):
    first, second = vocabularies
    of_a, of_b = spelled(first, second)
    links, out, counts = [], [], Counter()
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        if not t or b"".join(map(of_a, a)) != (" " + t).encode() or b"".join(map(of_b, b)) != (" " + t).encode():
            links.append([])
            out.append((0, 0, 0, 0, ""))
            continue
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(mine)
        mine = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(t) < 3000 else merged(*spans)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        sides = [defaultdict(list), defaultdict(list)]
        for side, mine_spans in zip(sides, spans):
            k = 0
            for s, e, i in mine_spans:
                while s >= cuts[k]:
                    k += 1
                side[k].append(str(i))
        groups = ";".join(",".join(sides[0][k]) + "|" + ",".join(sides[1][k]) for k in range(len(cuts)))
        links.append(mine)
        counts.update(set(mine))
        out.append((len(a), len(b), len(cuts), len(mine), hashlib.sha256(groups.encode()).hexdigest()))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(*o[:4], sum(counts[p] == best[p[0]] for p in mine), sum(counts[p] for p in mine), o[4]) for o, mine in zip(out, links)]


def merged(a, b):
    """Overlaps by walking both lists."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][2], b[j][2]))
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n\t x", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ block", "é é ﬁ Ω", "\U0001f600\U0001f468‍\U0001f469", "中文字符",
    "a\x00b", "12345 6,789.00 it's we'll", "a" * 5000, "ab " * 700, "don't", " nbsp ", "same text", "same text",
]


def test_alignment(spark, edge_texts, vocabularies, monkeypatch):
    texts = TEXTS + edge_texts
    rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted([(r[0], *b) for r, b in zip(rows, brute(texts, vocabularies))], key=str)
    for most in (20_000, 8 << 20):
        monkeypatch.setattr(alignment, "CELL_BYTES", most)
        got = alignment.align(df.repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert alignment.align(df.limit(0)).count() == 0
    assert sum(w[1] == 0 for w in want) < 8


def test_other_ids(spark):
    df = spark.createDataFrame([("x", "one two"), (None, "one two"), ("y", None)], "name string, text string")
    got = {r["name"]: (r["n_links"], r["count_sum"]) for r in alignment.align(df, "name").collect()}
    assert got["x"] == got[None] == (2, 4) and got["y"] == (0, 0)


def test_whole_corpus_encodes_as_the_named_file(spark, vocabularies):
    """The faster encoder of the same vocabulary gives the ids of the file's own library, over all documents of a table."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where(F.col("text").isNotNull()).collect()]
    tok = alignment.Tokenizers.read()
    tok.load()
    first, _ = tok.encode(texts)
    assert [x.tolist() for x in first] == [e.ids for e in vocabularies[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]

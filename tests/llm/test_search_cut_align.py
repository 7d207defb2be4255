"""Top-k search, fill-in-the-middle and token alignment against brute force, and on nulls, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidewire.llm import alignment, fill_middle, queries, topk

DOCS = "doc_id long, text string, n long, form string, fim_output string, text_hash string, block string, key string, spot int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, 7, "f", "o", "h", "b", "k", 3) for i, t in pairs], DOCS)


@pytest.mark.parametrize("name, table", [("op11_topk_vectors", "embeddings"), ("op12_fill_middle", "documents")])
def test_query_equals_sql(spark, tiny, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tiny}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, tiny)
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


# --- 11


def brute_top(vectors, k=5, every=50, scale=256):
    """Counter of (query_id, rank, vec_id, score) over rows that may repeat."""
    whole = []
    for i, v in vectors:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(scale * float(x))) for x in v]))
    out = Counter()
    for at, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(whole) if b != at)
            out.update((i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k], 1))
    return out


def top(spark, vectors, **how):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank int, no string")
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(frame, **how).collect())


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 12))
    out = [(i, [float(np.float32(x)) for x in centres[i % 6] * (i % 4 > 0) + rnd.normal(size=12) / 3]) for i in range(700)]
    out += [(i, out[3][1]) for i in range(700, 820)]  # a vector that many rows have
    out += [(i, [0.0] * 12) for i in (850, 851, 900)]  # ties all along
    return out


def test_top_equals_brute_force(spark, vectors, monkeypatch):
    assert top(spark, vectors) == brute_top(vectors)
    monkeypatch.setattr(topk, "BLOCK", 1500)  # many blocks, segments and sets of queries
    monkeypatch.setattr(topk, "QUERIES", 60)
    assert top(spark, vectors, k=3) == brute_top(vectors, k=3)
    assert top(spark, vectors[:4], query_every=1) == brute_top(vectors[:4], every=1)  # fewer than k others


def test_top_over_segments(vectors, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 12 * 50)
    quantise = lambda v: np.floor(np.array(v) * 256).astype(np.int64)
    block = pd.DataFrame({"no": [str(i) for i, _ in vectors], "id": [i for i, _ in vectors], "no_id": False, "copies": 1, "vector": [quantise(v) for _, v in vectors]})
    got = topk.best_of_block(block[block["id"] % 50 == 0][["no", "vector"]], block, 5)
    got = got.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_no").head(5)
    want = brute_top(vectors)
    assert {(q, v, s) for q, v, s in zip(got.query_no.astype(int), got.vec_id, got.score)} == {(q, v, s) for q, _, v, s in want}


def test_top_reads_part_of_the_lists(vectors):
    """Where some stand out, the lists are not read to their ends."""
    lists = topk.Lists(np.array([np.floor(np.array(v) * 256) for _, v in vectors[:600]]))
    wants = lists.vectors[:40]
    scores = lists.vectors @ wants.T
    floors = np.sort(scores, axis=0)[-5]
    given = np.full(40, -1e12)
    alive = lists.contenders(wants, np.zeros((600, 40), bool), 5, given)
    assert alive[scores >= floors].all() and alive.sum() < 40 * 60 and (given <= floors).all()
    alive = lists.contenders(wants, np.zeros((600, 40), bool), 5, floors.copy())
    assert alive[scores >= floors].all() and alive.sum() < 40 * 15


def test_top_of_odd_rows(spark):
    odd = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0]), (50, []), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf")]), (None, [3.0, 3.0]), (None, [3.0, 3.0]), (7, [1.0, 2.0, 3.0]), (-50, [-1.0, 0.5])]
    assert top(spark, odd) == brute_top(odd)
    assert top(spark, odd, k=2) == brute_top(odd, k=2)
    assert not top(spark, [])
    assert not top(spark, [(1, [1.0])])
    for size in (1e6, 1e7):  # sums beyond 53 and 62 bits
        large = [(0, [size, 1.0]), (1, [size, 2.0]), (2, [-size / 4, 1.0]), (None, [size, 2.0]), (4, [0.0, 0.0])]
        assert top(spark, large) == brute_top(large)
    with pytest.raises(PythonException, match="64 bits"):
        top(spark, [(0, [1e12]), (1, [1e12])])


# --- 12

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(i, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def made(spark, pairs):
    out = fill_middle.fill_in_middle(docs_of(spark, pairs)).withColumn("back", fill_middle.restore(F.col("_fim_output"), F.col("fim_form")))
    return Counter((r.doc_id, r.text, r.fim_n, r.fim_form, r.fim_prefix and len(r.fim_prefix), r.fim_middle and len(r.fim_middle), r._fim_output, r.back, r.n, r.form, r.fim_output) for r in out.collect())


def wanted(pairs):
    out = Counter()
    for i, t in pairs:
        n, form, p, m, text = brute_cut(i, t)
        out[i, t, n, form, p or (None if form == "plain" else ""), m or (None if form == "plain" else ""), text, t or "", 7, "f", "o"] += 1
    return out


def test_cuts_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "é", "漢", "😀", "\x1c", " ", "　", "<", "P>", "\x00"]
    pairs = [(i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))) for i in range(600)]
    pairs += [(None, "no id here"), (None, None), (5, None), (6, ""), (7, "   "), (8, "with <P> in it"), (8, "with <P> in it"), (-3, "below zero " * 9), (9, "é " * 300000)]
    assert made(spark, pairs) == wanted(pairs)
    assert {form for _, _, _, form, *_ in made(spark, pairs)} == {"plain", "psm", "spm"}
    assert not made(spark, [])


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_slices_cut_alike(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "SLICE", size)
    texts = ["one two  three ", None, "", "  x", "漢字 と\nabc", " ", "end"]
    draws = [[3, 1, 0, 5, 7, 1, 9], [8, 4, 2, 2, 1, 0, 1]]
    whole = fill_middle._parts(pa.array(["cut off", *texts])[1:], *map(pa.array, draws), pa.array([True] * 7)).to_pylist()
    for text, a, b, got in zip(texts, *draws, whole):
        units = TOKEN.findall(text or "")
        lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        assert got == {"n": len(units), "prefix": "".join(units[:lo]), "middle": "".join(units[lo:hi]), "suffix": "".join(units[hi:])}


# --- 13

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level():
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_align(pairs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    char = byte_level()

    def spans(ids, token):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(token(i))))
            at += len(token(i))
        return out

    a_bytes = lambda i: bytes(char[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for i, text in pairs:
        xs = spans(a.encode(" " + text, add_special_tokens=False).ids, a_bytes) if text else []
        ys = spans(b.encode(text), b_bytes) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(a_bytes(x) for x, *_ in xs) != whole or b"".join(b_bytes(y) for y, *_ in ys) != whole:
            xs, ys = [], []
        linked = [(x, y) for x, s, e in xs for y, f, g in ys if s < g and f < e]
        counts.update(linked)
        groups = [([], [])] if xs else []
        ends = {e for *_, e in xs} & {e for *_, e in ys}
        for end in sorted(ends):
            since = max((e for e in ends if e < end), default=0)
            groups.append(([x for x, s, e in xs if since < e <= end], [y for y, s, e in ys if since < e <= end]))
        groups = groups[1:]
        key = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        docs.append((i, len(xs), len(ys), len(groups), linked, hashlib.sha256(key.encode()).hexdigest() if xs else ""))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return Counter((i, n, m, g, len(l), sum(counts[p] == highest[p[1]] for p in l), sum(counts[p] for p in l), sha) for i, n, m, g, l, sha in docs)


def aligned(spark, pairs):
    out = alignment.align_tokens(docs_of(spark, pairs).repartition(3), a_path=A, b_path=B)
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())


ODD = [None, "", " ", "  \n\t ", "▁marked", "a▁b", "<|endoftext|> <s> </s> <0x0A> <unk>", "naïve café ﬁne ½", "漢字かな交じり文 😀😀 👩‍👩‍👧", "\x00\x01", "don't we'll", "x" * 700, " " * 300, "a\r\n\r\nb c　d", "é", "\U000323af \U0001fae8"]


def test_alignment_equals_brute_force(spark, tiny, monkeypatch):
    texts = [t for (t,) in duckdb.sql(f"select text from '{tiny}/documents.parquet' where n_chars < 1500 order by doc_id limit 60").fetchall()]
    pairs = [(k, t) for k, t in enumerate([*ODD, *texts])] + [(None, "no id"), (3, "twice"), (3, "twice")]
    want = brute_align(pairs)
    assert sum(not n for _, n, *_ in want) >= 4
    assert aligned(spark, pairs) == want
    assert not aligned(spark, [])
    assert aligned(spark, [(1, None)]) == Counter([(1, 0, 0, 0, 0, 0, 0, "")])


def test_slices_intern_alike(monkeypatch):
    import pyarrow as pa

    pair = alignment.Pair.of(A, B)
    texts = [t or "" for t in ODD] * 2
    nulls = pa.nulls(len(texts), pa.int64())
    whole, kinds = list(alignment.code_slice(0, nulls, nulls, texts, pair))
    single = [next(iter(alignment.code_slice(0, nulls[:1], nulls[:1], [t], pair))) for t in texts]
    for column in ("n_a", "n_b", "n_groups", "groups_sha256"):
        assert whole[column].to_pylist() == [s[column][0].as_py() for s in single]
    spread = Counter()
    for spots, times in zip(whole["spots"].to_pylist(), whole["times"].to_pylist()):
        spread.update(dict(zip(spots, times)))
    assert spread == dict(zip(kinds["spot"].to_pylist(), kinds["freq"].to_pylist()))


def test_ranks_and_library_agree_on_every_character():
    """The faster library is held to the tokenizer's own on all code points."""
    own = alignment.ByteLevel(A)
    assert own._ranks
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50000):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}. {chr(c)} \n{chr(c)}{chr(c)}" for c in points[at : at + 50000]]
        ranks, own._ranks = own._ranks, None
        slow = own.encode(texts)
        own._ranks = ranks
        assert own.encode(texts) == slow

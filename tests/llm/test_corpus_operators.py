"""Each operator against a brute-force version, and on nulls, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat, decontaminate, line_dedup, minhash_dedup, packing, pii, quality, queries, syncmers, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, _id string, extra int"


def docs_of(spark, pairs):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t), "x", "y", 1) for i, t in pairs], DOCS)


#: Names that an operator might use for itself, as columns of the user's.
CLASH = ("_id", "_hash", "_copy", "_gone", "later", "_found", "_new", "_late", "m_id", "m_hash", "l_id", "kind", "row", "hash", "mark", "no_id", "spots", "gone", "e", "w", "canon", "first")
VALUES = tuple(f"v{k}" for k in range(len(CLASH)))


def clashing(spark, pairs):
    return spark.createDataFrame([(i, t, *VALUES) for i, t in pairs], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASH)]))


def test_columns_of_the_caller_keep_their_values(spark):
    pairs = [(i, f"{'a b c d e f g ' * (1 + i % 3)}\nx@y{i}.org called\nthird line {i}") for i in range(6)] + [(None, None), (2, "")]
    docs = clashing(spark, pairs)
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    for out in (
        line_dedup.dedup_lines(docs),
        minhash_dedup.drop_near_duplicates(docs),
        pii.replace_entities(docs, key="k"),
        decontaminate.drop_contaminated(docs, bench),
        quality.drop_low_quality(docs, labels),
    ):
        got = out.select(*CLASH).collect()
        assert got and {tuple(r) for r in got} == {VALUES}


ODD = [(1, None), (2, ""), (3, "  \n "), (None, "some words here"), (None, "some words here"), (4, "a"), (4, "a"), (5, "word " * 30000)]


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randint(2, 7))) for _ in range(600)]
    return lambda n: " ".join(rnd.choice(words) for _ in range(n))


# --- 1


def brute_groups(pairs, percent):
    def shingles(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, prose, percent):
    rnd = random.Random(percent)
    pairs = []
    for g in range(6):
        base = prose(120).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = prose(1)
            pairs.append((len(pairs), " ".join(copy).upper() if rnd.random() < 0.3 else "\t".join(copy)))
    shared = prose(60)
    pairs += [(len(pairs) + k, shared + " " + prose(50)) for k in range(25)]
    pairs += [(len(pairs) + k, t) for k, t in enumerate(["one two", "One  two", "one", "", "É é", "é É"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, pairs), percent=percent).collect()}
    want = brute_groups(pairs, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_near_duplicates_over_a_bridge(spark):
    """A copy that only the hub's neighbour links: one edit from hub to bridge, as many from there as a link allows."""
    rnd = random.Random(8)
    pairs = []
    for g in range(24):
        n = rnd.randint(300, 3000)
        hub = [f"w{g}x{i}" for i in range(n + 4)]

        def edited(words, spots, tag):
            return [f"{tag}{k}" if k in spots else w for k, w in enumerate(words)]

        most = n * 15 // (185 * 5)
        spots = rnd.sample(range(5, n - 5, 8), most + 4)
        bridge = edited(hub, spots[:1], f"b{g}x")
        far = edited(bridge, spots[1 : most + 1], f"f{g}x")
        copies = [edited(hub, [k], f"c{g}x{k}x") for k in spots[most + 1 :]]
        pairs += [(len(pairs) + k, " ".join(t)) for k, t in enumerate([hub, bridge, far, *copies])]
    rnd.shuffle(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, pairs), percent=85).collect()}
    assert got == brute_groups(pairs, 85)
    assert len({c for _, c in got.values()}) == 24


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_chains_cuts_and_inclusions(spark, prose, percent):
    """Groups of few texts near the threshold: chains of edits, texts cut at either end, texts within others."""
    rnd = random.Random(percent + 1)
    pairs = []
    for g in range(130):
        base = [f"w{g}x{i}" for i in range(rnd.randint(30, 220))]
        edge = max(1, len(base) * (100 - percent) // 100)
        group = [base]
        for _ in range(rnd.randint(1, 4)):
            words = list(rnd.choice(group))
            how, n = rnd.choice(["cut", "head", "grow", "change", "one"]), rnd.randint(max(1, edge - 4), edge + 3)
            if how == "cut":
                words = words[:-n]
            elif how == "head":
                words = words[n:]
            elif how == "grow":
                words += [f"n{len(pairs)}y{k}" for k in range(n)]
            elif how == "change":
                at = rnd.randrange(max(1, len(words) - n))
                words[at : at + max(1, n - 4)] = [f"c{len(pairs)}z{rnd.random()}" for _ in range(max(1, n - 4))]
            else:
                words = words[:-1]
            group.append(words)
        pairs += [(len(pairs) + k, " ".join(t)) for k, t in enumerate(group)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, pairs), percent=percent).collect()}
    assert got == brute_groups(pairs, percent)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_dedup.near_duplicates(docs_of(spark, [*ODD, (9, "SOME words here")])).collect()
    by = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got]
    assert Counter(by) == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, 9, False), (None, 1, 9, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (9, 1, 9, True)])
    left = minhash_dedup.drop_near_duplicates(docs_of(spark, ODD))
    assert left.columns == docs_of(spark, ODD).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5]
    assert minhash_dedup.near_duplicates(docs_of(spark, ODD[:0] or []).limit(0)).count() == 0


# --- 2


def brute_align(item, words):
    best = 0
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            same = decontaminate.MATCH if item[i - 1] == words[j - 1] else decontaminate.DIFFER
            h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_full_table():
    rnd = random.Random(2)
    for _ in range(60):
        a = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))], np.uint64)
        b = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))], np.uint64)
        assert decontaminate.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_leaks_are_found_and_clean_documents_left(spark, prose):
    rnd = random.Random(4)
    items = [prose(30) for _ in range(8)]
    docs, want = [], set()
    for i in range(60):
        text = prose(200).split()
        if i % 3 == 0:
            item = items[i % 8].split()
            for _ in range(4):
                item[rnd.randrange(len(item))] = prose(1)
            at = rnd.randrange(200)
            text[at:at] = [w.upper() + "!" for w in item]
            want.add((i, i % 8))
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, "ab cd"), (10, "")], "item_id long, text string")
    got = decontaminate.benchmark_leaks(docs_of(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontaminate.drop_contaminated(docs_of(spark, docs), bench)
    assert {r.doc_id for r in left.collect()} == {i for i in range(60) if i % 3}
    assert decontaminate.drop_contaminated(docs_of(spark, ODD), bench).count() == len(ODD)
    assert decontaminate.benchmark_leaks(docs_of(spark, ODD), bench.limit(0)).count() == 0
    assert decontaminate.benchmark_leaks(docs_of(spark, ODD).limit(0), bench).count() == 0


def edited_copy(rnd, words, share, fresh):
    """Words changed, left out, put in, and halves that change places, ``share`` of the words in all."""
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        k = rnd.randrange(len(out))
        how = rnd.choice(["change", "drop", "add"])
        out[k : k + (how != "add")] = [] if how == "drop" else [fresh(1)]
    return out


def test_leaks_equal_brute_force_over_all_pairs(spark, prose):
    """Insertions, deletions and substitutions: each pair's best alignment by the full table decides what there is to find."""
    rnd = random.Random(21)
    items = [prose(rnd.randint(8, 40)) for _ in range(25)]
    docs = []
    for i in range(120):
        text = prose(rnd.randint(0, 90)).split()
        for _ in range(rnd.choice([0, 1, 1, 2])):
            at = rnd.randint(0, len(text))
            text[at:at] = edited_copy(rnd, rnd.choice(items).split(), rnd.choice([0, 0.1, 0.2, 0.3]), prose)
        docs.append((i, " ".join(text)))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.benchmark_leaks(docs_of(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        words = decontaminate.word_ids(t)
        for j, item in enumerate(items):
            own = decontaminate.word_ids(item)
            points = decontaminate.align(own, words)[0]  # held to the full table above
            if points >= 0.5 * decontaminate.MATCH * len(own):
                want[i, j] = points / (decontaminate.MATCH * len(own))
    found = set(got) & set(want)
    print(f"recall {len(found) / len(want):.3f} of {len(want)} pairs")
    assert set(got) <= set(want) and len(found) >= 0.97 * len(want) and len(want) > 80
    assert all(abs(got[p] - want[p]) < 1e-9 for p in found)


# --- 3

BPE = public_tokenizers.path("word_bpe_49k.json")


def check_packing(spark, pairs, pieces, size=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in pairs]
    total = sum(map(len, ids))
    assert sum(p.length for p in pieces) == total
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_seq) == list(range(-(-total // size)))
    for s, ps in by_seq.items():
        end = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end == size or s == max(by_seq)
    if len({i for i, _ in pairs}) == len(pairs):
        known = {i: x for (i, _), x in zip(pairs, ids)}
        for p in pieces:
            part = known[p.doc_id][p.start : p.start + p.length]
            assert p.doc_tokens == len(known[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing_round_trip(spark, prose):
    texts = [prose(random.Random(i).randint(0, 300)) for i in range(80)]
    texts += ["Ünïcode ΑΣ ς's don't I'LL 12.5 漢字!?…", "<|endoftext|> a", "x\x1cy\x85z w", "é İ ﬁ", None, "", "long " * 5000]
    pairs = list(enumerate(texts))
    pieces = packing.pack(docs_of(spark, pairs), tokenizer_path=BPE).collect()
    check_packing(spark, pairs, pieces)


def test_packing_keeps_the_mixture(spark, prose):
    pairs = [(i, prose(200)) for i in range(300)]
    pieces = packing.pack(docs_of(spark, pairs), tokenizer_path=BPE, window_sequences=4, targets={"src0": 0.5, "src1": 0.5}).collect()
    check_packing(spark, pairs, pieces)
    rounds = {}
    for p in pieces:
        rounds.setdefault(p.round_id, Counter())[p.source] += p.length
    first = [rounds[r] for r in sorted(rounds) if set(rounds[r]) == {"src0", "src1"}]
    assert len(first) >= 4 and all(abs(c["src0"] - c["src1"]) <= 1 for c in first[:-1])
    assert max(r for r in rounds if rounds[r]["src0"]) < min(r for r in rounds if rounds[r]["src2"])


def test_packing_ids_equal_the_tokenizer():
    """Control characters, marks and letters of late Unicode versions, alone and within words."""
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(BPE), packing.WordEncoder(BPE)
    same = lambda t: np.frombuffer(own.ids(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
    points = [*range(0x3000), *range(0xA000, 0xB000), *range(0xFB00, 0x11000), *range(0x11900, 0x11960), *range(0x1E000, 0x1E960), *range(0x1F300, 0x1F700)]
    assert [c for c in points if not (same(chr(c)) and same(f"ab{chr(c)}cd"))] == []
    rnd = random.Random(3)
    pool = "abcXYZ .,'\x00\x1b\x7f\x85\u0301\u0323\u1abf\u1ac9\u089a\u0345éß漢字ΑΣς😀\u200d\n\t"
    assert [t for t in ("".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) for _ in range(3000)) if not same(t)] == []


def test_packing_of_rare_targets_and_many_sources(spark, prose):
    rows = [(i, prose(40), "en", "rare" if i % 50 == 0 else f"s{i % 7}", 1, "x", "y", 1) for i in range(1500)]
    pairs = [(r[0], r[1]) for r in rows]
    aims = {f"s{k}": 1.0 for k in range(7)} | {"rare": 1e-9}
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path=BPE, targets=aims).collect()
    check_packing(spark, pairs, pieces)
    assert sum(p.source == "rare" for p in pieces) < 200 and len(pieces) < 8000
    many = [(i, prose(20), "en", f"src{i % 1000}", 1, "x", "y", 1) for i in range(2000)]
    for aims in ({"src1": 0.0}, 0.5):
        pieces = packing.pack(spark.createDataFrame(many, DOCS), tokenizer_path=BPE, targets=aims).collect()
        check_packing(spark, [(r[0], r[1]) for r in many], pieces)


def test_packing_meets_targets_in_every_window(spark, tiny):
    """Shares by size ** 0.7: while all queues last, each step serves them so, within a token."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    pieces = queries.op3_mixture_packing(spark, tiny).collect()
    held = Counter()
    for p in pieces:
        held[p.source] += p.length
    weight = {k: v**0.7 for k, v in held.items()}
    steps = {}
    for p in pieces:
        steps.setdefault(p.round_id, Counter())[p.source] += p.length
    full = [steps[r] for r in sorted(steps) if len(steps[r]) == len(held)][:-1]
    assert full and docs.select("source").distinct().count() == len(held)
    for c in full:
        for k in held:
            assert abs(c[k] - 16 * 2048 * weight[k] / sum(weight.values())) <= 2


def test_packing_of_odd_rows(spark):
    pieces = packing.pack(docs_of(spark, ODD), tokenizer_path=BPE).collect()
    check_packing(spark, ODD, pieces)
    assert packing.pack(docs_of(spark, ODD).limit(0), tokenizer_path=BPE).count() == 0


# --- 4


def test_syncmers_equal_brute_force(spark, prose):
    texts = [prose(40), "aa aa aa aa aa aa", "x y z", "", None, "one two three four", "字漢字漢字漢", "a" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    units = df.select("i", F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(syncmers._UNIT), F.lit(0)).alias("u"), syncmers.syncmers(F.col("t")).alias("s")).collect()
    hashed = spark.createDataFrame([(r.i, p, r.u[p : p + 2]) for r in units for p in range(max(0, len(r.u) - 1))], "i long, p int, g array<string>")
    inner = {(r.i, r.p): r.h for r in hashed.select("i", "p", F.xxhash64(F.col("g")[0], F.col("g")[1]).alias("h")).collect()}
    for r in units:
        n = len(r.u)
        if n < syncmers.K:
            assert [a.pos for a in r.s] == ([0] if n else [])
            continue
        want = []
        for p in range(n - syncmers.K + 1):
            h = [inner[r.i, p + j] for j in range(syncmers.K - syncmers.S + 1)]
            if h.index(min(h)) in (0, len(h) - 1):
                want.append(p)
        assert [a.pos for a in r.s] == want


def test_edited_fingerprints(spark, prose):
    pairs = [(i * 7, prose(20 + i)) for i in range(600)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(docs_of(spark, pairs)).collect()}
    assert len(got) == 600
    for k, (i, t) in enumerate(pairs):
        nxt = pairs[(k + 1) % len(pairs)][1]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert sum(r.near_edited for r in got.values()) / 600 > 0.15 > sum(r.near_next for r in got.values()) / 600
    assert all(r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint)) for r in got.values())
    odd = syncmers.edited_fingerprints(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.near_next <= 1 for r in odd)
    assert len({r.fingerprint for r in odd if r.doc_id == 4}) == 1
    one = syncmers.edited_fingerprints(docs_of(spark, [(1, "a b c d e f")])).first()
    assert one.near_next == 1.0
    assert syncmers.edited_fingerprints(docs_of(spark, ODD).limit(0)).count() == 0


def test_fingerprints_keep_every_anchor_and_its_place(spark, prose):
    texts = [prose(40), prose(2000), "aa " * 300, "x y z", "", None, "字漢字漢字漢" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("f", syncmers.fingerprint(F.col("t")))
    for r in df.select("i", "f", syncmers.syncmers(F.col("t")).alias("want"), syncmers.anchors_of(F.col("f")).alias("got")).collect():
        assert [(a.pos, a.hash) for a in r.got] == [(a.pos, format((a.hash & (1 << 64) - 1) >> 32, "08x")) for a in r.want]
        gaps = [y.pos - x.pos for x, y in zip(r.want, r.want[1:])]
        assert max(gaps, default=0) <= syncmers.K - syncmers.S


def brute_likeness(a, b):
    """From the strings alone: units of distinct stretches (both hashes and the distance) that both hold, over those of either."""

    def stretches(f):
        if not f:
            return set()
        codes, rest = f.split(".")
        parts = [codes[i : i + 10] for i in range(0, len(codes), 10)]
        return {(x[2:], y[2:], int(y[:2], 16)) for x, y in zip(parts, parts[1:])} | {(parts[-1][2:], "", int(rest))}

    x, y = stretches(a), stretches(b)
    return 1.0 if a == b else sum(s[2] for s in x & y) / sum(s[2] for s in x | y) if x and y else 0.0


def test_likeness_is_positional(spark, prose):
    a, b, mid = prose(300).split(), prose(300).split(), prose(60).split()
    pairs = {
        "same": (a, a),
        "shifted": (a, b[:17] + a),
        "cut": (a, a[100:]),
        "moved": (a, a[150:] + a[:150]),
        "passage": (a[:150] + mid + a[150:], b[:40] + mid + b[40:]),
        "apart": (a, b),
        "spread": (a, [w for x in a for w in (x, prose(1))]),
        "empty": (a, []),
    }
    df = spark.createDataFrame([(k, " ".join(x), " ".join(y)) for k, (x, y) in pairs.items()], "k string, a string, b string")
    df = df.select("k", syncmers.fingerprint(F.col("a")).alias("a"), syncmers.fingerprint(F.col("b")).alias("b"))
    got = {r.k: r for r in df.withColumn("near", syncmers.likeness(F.col("a"), F.col("b"))).collect()}
    near = {k: r.near for k, r in got.items()}
    assert near == pytest.approx({k: brute_likeness(r.a, r.b) for k, r in got.items()})
    assert near["same"] == 1 and near["apart"] == near["spread"] == near["empty"] == 0
    assert near["shifted"] > 0.9 and near["moved"] > 0.9 and 0.6 < near["cut"] < 0.72 and 0.05 < near["passage"] < 0.12
    found = {k: [] for k in pairs}
    for r in syncmers.shared_passages(df, "k", "a", "b").collect():
        found[r.k].append((r.begin_a, r.begin_b, r.units))
    assert not found["apart"] and not found["empty"]
    (x, y, n), = found["passage"]
    assert 150 <= x <= 154 and x - y == 110 and 50 <= n <= 60
    assert {y - x for x, y, _ in found["moved"]} == {150, -150} and len(found["moved"]) == 2


def test_successors_do_not_depend_on_the_ids(spark, prose):
    """One far id, repeated rows and null ids."""
    texts = [prose(8) for _ in range(400)]
    near = [(i, t) for i, t in enumerate(texts)]
    far = [(i if i < 399 else 2**60, t) for i, t in enumerate(texts)]
    one, two = ({(r.n_chars, r.edited_sha256, r.fingerprint): r.near_next for r in syncmers.edited_fingerprints(docs_of(spark, x)).collect()} for x in (near, far))
    assert one == two
    sizes = syncmers.with_successor(docs_of(spark, far)).filter("NOT extra").groupBy("slice").count().collect()
    assert max(r["count"] for r in sizes) == syncmers._SLICE_ROWS
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n")] + [(1, "a b c d e f g")] * 3
    got = sorted((r.doc_id, r.near_next, r.edited_sha256) for r in syncmers.edited_fingerprints(docs_of(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 1.0, sha("a b c da b c "))] * 3 + [(1, 0.0, sha("a b c dh i j ")), (2, 0.0, sha("h i j ka b c "))])


# --- 5


def test_lines_equal_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
    want = sorted(con.execute(line_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, queries.op5_line_dedup(spark, tiny).collect())) == want


def test_lines_of_odd_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a \nb\nc\ny"), (3, "q\nq\nq\nq"), (4, "a\nb"), (4, "a\nb"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (None, "c\n\n\n\nd"), (6, None), (7, "\n\n\n\n")]
    out = line_dedup.dedup_lines(docs_of(spark, rows))
    got = sorted((r.doc_id or 0, r.text, r.line_count, r.lines_removed) for r in out.collect())
    assert got == sorted([(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "q", 4, 3), (4, "a\nb", 2, 0), (4, "a\nb", 2, 0), (5, "", 4, 4), (5, "", 4, 4), (0, "c\n\n\n\nd", 5, 0), (6, "", 1, 0), (7, "\n\n\n\n", 5, 0)])
    assert sorted((r.doc_id or 0, *r[-len(CLASH) - 2 : -2]) for r in line_dedup.dedup_lines(clashing(spark, rows)).select("doc_id", *CLASH, "text", "line_count").collect()) == sorted((i or 0, *VALUES) for i, _ in rows)
    assert line_dedup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


# --- 6


def test_token_counts_equal_the_tokenizer(spark, prose):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    tok = Tokenizer(models.Unigram(token_counts.load_vocabulary(path), unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rnd = random.Random(1)
    texts = [prose(50), "", " ", "  a", "▁▁x y", "漢字 é\n\t😀", "<s> <0x41>"] + ["".join(rnd.choice("abcdeth ▁é漢字x<0>\n😀ñ") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, enumerate(texts)), vocabulary_path=path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    odd = token_counts.token_counts(docs_of(spark, ODD), vocabulary_path=path).collect()
    assert len(odd) == len(ODD) and {r.n_tokens for r in odd if r.doc_id in (1, 2)} == {0}
    assert token_counts.token_counts(docs_of(spark, ODD).limit(0), vocabulary_path=path).count() == 0


# --- 7


def luhn(number):
    d = [int(c) for c in number][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_surrogates_refer_to_the_same_people(spark):
    """Family names follow in the same text, check digits stay valid, labels keep their place, and what is no entity stays."""
    rows = [
        (1, "Mr. John Smith came. Smith said that John and Mrs. Smith left; Smithson stayed. The Smith boat."),
        (2, "Later Pete Carlson wrote. Carlson, not Smith. Dr. Zuly Brankov and Zuly."),
        (3, "GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432, but GB83 WEST 1234 5698 7654 32 is wrong"),
        (4, "password=f4f61717b37e3f9f86 x token: 'hunter2000' y password please"),
        (5, "a" * 900 + "@mail.example.com"),
        (6, "Smith without a person. " * 3 + "word " * 40000),
    ]
    got = {r.doc_id: r for r in pii.replace_entities(docs_of(spark, rows), key="k").collect()}
    one, two = got[1].text, got[2].text
    family = one.split()[2]
    assert one == f"Mr. {one.split()[1]} {family} came. {family} said that {one.split()[1]} and Mrs. {family} left; Smithson stayed. The {family} boat."
    assert one.split()[1] in pii.MALE_NAMES and one.split()[1] != "John"
    assert "Carlson" not in two and "Zuly" not in two and "Brankov" not in two and "not Smith." in two and two.count(two.split()[2].strip(".,")) == 2
    a, b = got[3].text[:27].replace(" ", ""), got[3].text[31:53]
    assert a == b != "GB82WEST12345698765432" and mod97(a) == 1 and a[:2] == "GB" and "GB83 WEST 1234 5698 7654 32 is wrong" in got[3].text
    assert re.fullmatch(r"password=[0-9a-f]{18} x token: '[a-z]{6}\d{4}' y password please", got[4].text) and "f4f617" not in got[4].text and "hunter" not in got[4].text
    assert re.fullmatch(r"[a-z]{900}@[a-p]{8}\.example", got[5].text) or re.fullmatch(r"[a-z]{900}@\w{8}\.example", got[5].text)
    assert got[6].text == rows[5][1] and got[6].n_entities == 0
    with pytest.raises(ValueError):
        pii.replace_entities(docs_of(spark, rows), key="")


def test_surrogates_equal_a_scan_by_hand(spark, tiny):
    """Python's own patterns for what the tables hold: the same documents change, each entity to one stand-in, and all distinct."""
    import regex

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.replace_entities(docs_of(spark, docs), key="k").collect()}
    pattern = regex.compile(r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))|(?P<phone>\+1 \(\d{3}\) \d{3}-\d{4})|(?<!\w)(?P<card>\d{16})(?!\w)|(?<!\w)(?P<secret>[0-9a-fA-F]{40})(?!\w)|password=(?P<password>\w{8,})")
    known, changed = {}, 0
    for i, text in docs:
        at, want = 0, []
        for m in pattern.finditer(text or ""):
            kind = m.lastgroup
            if kind == "card" and not luhn(m["card"]):
                continue
            want.append((kind, m[kind]))
        assert got[i].n_entities == len(want)
        changed += bool(want)
        assert (got[i].text == (text or "")) == (not want)
        for (kind, form), s in zip(want, got[i].surrogates):
            canon = form.lower() if kind in ("email", "secret") else form
            assert known.setdefault((kind, canon), s.surrogate.lower()) == s.surrogate.lower() != canon
            assert len(s.surrogate) == len(form) or kind in ("email", "ip")
    assert changed > 5 and len(set(known.values())) == len(known)


def test_surrogates(spark):
    rows = [
        (1, "Mail Ana.b@Mail3.example.com, call +1 (017) 555-7713; Mr. James Smith met Frau Müller at 97.51.17.173."),
        (2, "ana.b@mail3.example.com or 017-555-7713? card 4012 8888 8888 1881, 4012888888881881; id 1700000000000 and 1700000000123 ms"),
        (3, 'TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Иван Петров'),
        (4, None),
        (4, "no data here, version 2.0"),
        (None, "+1 (017) 555-7713"),
    ]
    out = {(r.doc_id, i): r for i, r in enumerate(pii.replace_entities(docs_of(spark, rows), key="k").orderBy("doc_id", "text").collect())}
    texts = [r.text for r in out.values()]
    found = [s for r in out.values() for s in r.surrogates]
    for secret in ("mail3", "555-7713", "Smith", "Müller", "97.51", "4012", "04dbeb", "04DBEB", "Петров"):
        assert not any(secret in t for t in texts)
    mails = {s.surrogate.lower() for s in found if s.kind == "email"}
    cards = {re.sub(r"\D", "", s.surrogate) for s in found if s.kind == "card"}
    secrets = {s.surrogate.lower() for s in found if s.kind == "secret"}
    assert len(mails) == len(cards) == len(secrets) == 1
    phones = [s.surrogate for s in found if s.kind == "phone"]
    assert len(phones) == 3 and len({p for p in phones if p.startswith("+")}) == 1
    names = {s.surrogate for s in found if s.kind == "name"}
    assert any(n.startswith("Mr. ") and n.split()[1] in pii.MALE_NAMES for n in names) and any(n.startswith("Frau ") and len(n.split()) == 2 for n in names)
    assert any(n.split()[0] in pii.CYRILLIC_MALE for n in names)
    assert any("id 1700000000000 and 1700000000123 ms" in t for t in texts) and all(luhn(c) for c in cards)
    assert sorted(t for t in texts if "version" in t or not t) == ["", "no data here, version 2.0"]
    assert pii.replace_entities(docs_of(spark, rows).limit(0), key="k").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Stand-ins from a tiny space collide at first, and are parted."""
    monkeypatch.setattr(pii, "LATIN_SYLLABLES", ["ba", "do"])
    rows = [(i, f"Mr. James {chr(65 + i)}xyz") for i in range(12)]
    got = pii.replace_entities(docs_of(spark, rows), key="k").collect()
    assert len({r.text for r in got}) == 12


def test_surrogates_find_room_for_many_names(spark, monkeypatch):
    """Far more names than first stand-ins, of which there are 16."""
    monkeypatch.setattr(pii, "LATIN_SYLLABLES", ["ba", "do"])
    rows = [(i, f"Mr. James {chr(65 + i % 26)}{chr(97 + i // 26)}xyz") for i in range(300)]
    got = pii.replace_entities(docs_of(spark, rows), key="k").collect()
    assert len({r.text for r in got}) == 300


def test_listed_names_trade_places_by_key():
    """Nobody keeps a name, no two share one, and the distances in the list tell nothing."""
    for names in (pii.MALE_NAMES, pii.CYRILLIC_FEMALE):
        one, other = (pii._trades(names, key, "x") for key in ("k", "l"))
        assert sorted(one) == sorted(names) and all(a != b for a, b in zip(names, one)) and one != other
        far = {(names.index(b) - names.index(a)) % len(names) for a, b in zip(names, one)}
        assert len(far) > len(names) / 3


def test_surrogates_of_long_secrets(spark):
    rows = [(1, "token=" + "ab1" * 47), (2, "key " + "01f" * 54 + " end"), (3, "password=hunterhunter"), (4, "password: required by the form"), (5, "Victoria Station is closed"), (6, "sk_" + "aB3" * 100)]
    got = {r.doc_id: r for r in pii.replace_entities(docs_of(spark, rows), key="k").collect()}
    assert [got[i].n_entities for i in range(1, 7)] == [1, 1, 1, 0, 0, 1]
    for i in (1, 2, 3, 6):
        old, new = rows[i - 1][1], got[i].text
        assert len(old) == len(new) and not any(old[k : k + 12] in new for k in range(6, len(old) - 12))
    assert got[2].text.startswith("key ") and got[2].text.endswith(" end") and got[5].text == "Victoria Station is closed"


# --- 8, 9


def test_quality_learns(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    docs = docs.unionByName(docs.limit(0))
    half = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r.keep for r in quality.score_quality(docs, half).collect()}
    held = [(r.quality == 1, got[r.doc_id]) for r in labels.filter("doc_id % 2 = 1").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.keep and r.quality == 1.0 for r in got)
    both = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs_of(spark, ODD), both).count() == len(ODD)
    assert quality.score_quality(docs_of(spark, ODD).limit(0), both).count() == 0
    assert quality.drop_low_quality(docs_of(spark, ODD), labels).columns == docs_of(spark, ODD).columns


def test_quality_is_calibrated_on_held_out_labels(spark, prose):
    """Quality shows in words and, less surely, in the source; the scores are probabilities on labels that nothing was fitted to."""
    rnd = random.Random(12)
    good, bad = ["lemma", "proof", "theorem", "result"], ["click", "buy", "cheap", "win"]
    rows, labels = [], []
    for i in range(1600):
        y = rnd.random() < 0.6
        words = prose(40).split()
        words[3:3] = rnd.choices(good if y == (rnd.random() < 0.95) else bad, k=3)
        rows.append((i, " ".join(words), "en", f"s{int(y if rnd.random() < 0.8 else not y)}", 1, "x", "y", 1))
        labels.append((i, int(y)))
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, marks.filter("doc_id % 2 = 0")).collect()}
    again = {r.doc_id: r.quality for r in quality.score_quality(docs, marks.filter("doc_id % 2 = 0")).collect()}
    assert all(abs(again[i] - r.quality) < 1e-6 for i, r in got.items())
    held = [(y, got[i].quality) for i, y in labels if i % 2]
    assert sum((q >= 0.5) == (y == 1) for y, q in held) / len(held) > 0.93
    for lo, hi in ((0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        some = [(y, q) for y, q in held if lo <= q < hi]
        assert len(some) < 40 or abs(np.mean([y for y, _ in some]) - np.mean([q for _, q in some])) < 0.12
    assert np.mean([got[i].p_text >= 0.5 for i, y in labels if y]) > 0.85 and np.mean([got[i].p_page >= 0.5 for i, y in labels if y]) > 0.6


def test_quality_is_taught_by_all_documents(spark, prose):
    """A few labels, on documents whose source tells the class: words that no labelled document has are learnt from all others."""
    rnd = random.Random(3)
    rows = []
    for i in range(1200):
        y, new = i % 2, i >= 200  # the words of the later ones are other words
        words = prose(30).split()
        words[3:3] = rnd.choices(["lemma", "proof"] if not new and y else ["click", "buy"] if not new else ["axiom", "corollary"] if y else ["deal", "coupon"], k=3)
        rows.append((i, " ".join(words), "en", f"s{y}", 1, "x", "y", 1))
    hidden = [(5000 + i, " ".join(prose(30).split() + rnd.choices(["axiom", "corollary"] if i % 2 else ["deal", "coupon"], k=3)), "en", "other", 1, "x", "y", 1) for i in range(200)]
    docs = spark.createDataFrame(rows + hidden, DOCS)
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    taught, alone = ({r.doc_id: r.p_text for r in quality.score_quality(docs, marks, rounds=n).collect()} for n in (2, 0))
    right = lambda p: np.mean([(p[5000 + i] >= 0.5) == bool(i % 2) for i in range(200)])
    assert right(taught) > 0.95 > 0.75 > right(alone)


def test_quality_minimises():
    """The minimum of a loss with a known solution, and the sums of slices against the whole."""
    rnd = np.random.default_rng(0)
    x = np.hstack([rnd.normal(size=(500, 3)), np.ones((500, 1))]).astype(np.float32)
    y = (x @ np.array([1.0, -2.0, 0.0, 0.5]) + rnd.logistic(size=500) > 0).astype(float)
    scale = quality.Scale(np.array([1.0, 1.0, 1.0, 0.0]), 1e-2)
    objective = lambda w: scale.whole(quality.loss_sums(x, y, w), w)
    w = quality.minimise(objective, np.zeros(4), 100, 1e-12)
    assert np.abs(objective(w)[1]).max() < 1e-3
    for k in range(4):
        for d in (-0.05, 0.05):
            assert objective(w + d * np.eye(4)[k])[0] > objective(w)[0]
    halves = quality.loss_sums(x[:200], y[:200], w) + quality.loss_sums(x[200:], y[200:], w)
    assert np.allclose(halves, quality.loss_sums(x, y, w), rtol=1e-4, atol=1e-2)


def test_quality_of_a_labelled_id_with_many_texts(spark, prose):
    """A third of all rows share a labelled id: one of them is in the fit."""
    rows = [(i, prose(20) + (" proof" if i % 2 else " click")) for i in range(200)] + [(7, prose(20) + f" {k}") for k in range(100)]
    docs, marks = docs_of(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = [r.quality for r in quality.score_quality(docs, marks).orderBy("doc_id", "text_hash").collect()]
    turned = [r.quality for r in quality.score_quality(docs_of(spark, rows[::-1]), marks).orderBy("doc_id", "text_hash").collect()]
    assert len(got) == 300 and np.allclose(got, turned, atol=1e-3)


def test_toxicity_orders_severity(spark, prose):
    """Labels of four grades; the words of higher ones are other words, and none is told to the model."""
    rnd = random.Random(9)
    bad = {1: ["silly", "dull", "lame"], 2: ["stupid", "awful", "gross"], 3: ["scum", "vermin", "filth"]}
    rows, labels = [], []
    for i in range(900):
        grade = rnd.choice([0, 0, 0, 1, 2, 3])
        words = prose(60).split()
        words[5:5] = rnd.choices(bad[grade], k=2) if grade else []
        rows.append((i, " ".join(words)))
        labels.append((i, grade))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, marks.filter("doc_id % 2 = 0"))
    assert len(model.cuts) == 3 and list(model.cuts) == sorted(model.cuts)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(g, got[i].grade) for i, g in labels if i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    level = lambda g: np.mean([got[i].expected_severity for i, h in labels if h == g and i % 2])
    assert level(0) < 0.2 and level(1) > level(0) + 0.5 and level(2) > level(1) + 0.5 and level(3) > level(2) + 0.5
    two = toxicity.train(docs, marks.selectExpr("doc_id", "cast(toxic > 0 as int) as toxic").filter("doc_id % 2 = 0"))
    assert len(two.cuts) == 1
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, two).collect()}
    assert np.mean([scored[i].toxic == (g > 0) for i, g in labels if i % 2]) > 0.97
    odd = toxicity.score_toxicity(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd)
    nothing = toxicity.train(docs, marks.limit(0))
    assert not any(r.toxic for r in toxicity.score_toxicity(docs.limit(5), nothing).collect())
    # Of texts that share an id one is chosen by its hash, whatever the order of the rows.
    twice = docs_of(spark, rows + [(i, t + " more") for i, t in rows])
    turned = docs_of(spark, [(i, t + " more") for i, t in rows[::-1]] + rows)
    one, other = (toxicity.train(d, marks) for d in (twice, turned))
    assert one.words == other.words and np.allclose(one.weights, other.weights)


def test_ordinal_fit_shares_weights():
    rows = [np.array([0])] * 40 + [np.array([1])] * 40 + [np.array([0, 1])] * 40 + [np.array([], int)] * 80
    grades = np.array([1] * 40 + [2] * 40 + [3] * 40 + [0] * 80)
    w, cuts = toxicity.fit_ordinal(rows, grades, 2)
    assert 0 < w[0] < w[1] and cuts[0] < w[0] < cuts[1] < w[1] < cuts[2] < w.sum()


# --- 10


def test_chat_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tiny}/conversations.parquet'")
    out = con.execute(chat.ORACLE)
    names = [c[0] for c in out.description]
    got = queries.op10_chat_perspectives(spark, tiny).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(out.fetchall())


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "ann", "hi <|end|>"), (1, 1, "bob", None), (1, None, "ann", "last"), (1, 2, None, "who"), (2, 0, "system", "s"), (None, 0, "ann", "x"), (1, 0, "system", "be kind")]
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.text == "<|assistant|>\nhi < |end|><|end|>\n<|system|>\nbe kind<|end|>\n<|user:bob|>\n<|end|>\n<|user:unknown|>\nwho<|end|>\n<|assistant|>\nlast<|end|>\n"
    assert [ann.text[s.begin : s.finish] for s in ann.spans] == ["hi < |end|><|end|>", "last<|end|>"]
    assert "".join(ann.text[t.at : t.finish + 1] for t in ann.turns) == ann.text
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("conv", [7, None])
def test_chat_of_a_long_conversation(spark, conv):
    """Parts are for every participant alike, whoever speaks in them, and one behind another they are the dialogue."""
    turns = [(conv, t, "ann" if t % 2 else "bob", f"t{t}", "extra") for t in range(2500)] + [(conv, 3, "ann", "t3", "extra")] * 40 + [(conv, None, "late", "last", "x"), (conv, 0, "cleo", "hello", "x")] + [(1, 0, "ann", "short", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string").repartition(5)
    sides = chat.rotate_perspectives(frame, part_turns=100).collect()
    order = sorted((r for r in turns if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    for me in ("ann", "bob", "cleo", "late"):
        whole = [("<|assistant|>" if who == me else f"<|user:{who}|>") + f"\n{text}<|end|>\n" for _, _, who, text, _ in order]
        own = sorted((r for r in sides if (r.conv_id, r.perspective) == (conv, me)), key=lambda r: r.part)
        assert [r.n_turns for r in own] == [100] * 25 + [42]
        assert "".join(r.text for r in own) == "".join(whole)
        assert [r.begin for r in own] == [len("".join(whole[: 100 * k])) for k in range(26)]
        said = [r.text[s.begin : s.finish] for r in own for s in r.spans]
        assert said == [f"{text}<|end|>" for _, _, who, text, _ in order if who == me]
    assert [r.text for r in sides if r.conv_id == 1] == ["<|assistant|>\nshort<|end|>\n"]
    each = chat.rendered_turns(chat.rotate_perspectives(frame, part_turns=100), 100).filter(F.col("conv_id").eqNullSafe(F.lit(conv)) & (F.col("perspective") == "cleo")).orderBy("n").collect()
    assert [r.n for r in each] == list(range(1, 2543)) and all(b.at == a.at + len(a.text) for a, b in zip(each, each[1:]))

"""Packing, source divergence and spelling variants against plain code."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import divergence, packing, pointers, queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOC = "doc_id long, text string, lang string, source string, n long, part int, ids string"

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves.
ODD = [
    (1, None, "en", "a", 1, 1, "x"),
    (2, "", None, None, 1, 1, "x"),
    (3, "Hello hello HELLO wörld naïve", "en", "a", 1, 1, "x"),
    (3, "Hello hello HELLO wörld naïve", "en", "a", 1, 1, "x"),
    (4, "hello wörld " * 400, "en", "b", 1, 1, "x"),
    (5, "x" * 5000 + " hello", "en", "c", 1, 1, "x"),
    (6, "日本語 hello ñandú <|endoftext|> it's 42!! 😀 \u0085 é", "es", "a", 1, 1, "x"),
    (None, "hello wörld hello", "en", "b", 1, 1, "x"),
    (7, "1 2 3", "fr", "a", 1, 1, "x"),
    (8, "× ÷ Schloß schloß SCHLOß schlosz", "en", "b", 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(1000)


def test_equal_runs_are_equal_words_in_the_order_of_their_places():
    rng = random.Random(1)
    words = [rng.choice("abc") * rng.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 200]) + rng.choice(["", "z", "ñ"]) for _ in range(500)]
    data = " ".join(words).encode()
    mask = np.frombuffer(data, np.uint8) != 32
    starts, ends, rows = pointers.runs(mask, np.array([0, len(data)]))
    order, new = pointers.equal_runs(np.frombuffer(data, np.uint8), starts, ends)
    found = [data[starts[i] : ends[i]].decode() for i in order]
    assert Counter(found) == Counter(words) and not rows.any()
    assert [a != b for a, b in zip(found, found[1:])] == new[1:].tolist()
    assert len(set(found)) == new.sum()
    assert all(a < b for a, b, fresh in zip(order, order[1:], new[1:]) if not fresh)
    assert pointers.cut_out(np.frombuffer(data, np.uint8), starts[order], ends[order]).to_pylist() == found


# Packing


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity", [4096, 64])
@pytest.mark.parametrize("table", ["odd", "documents"])
def test_pieces_are_the_librarys_ids_each_in_one_place(request, table, capacity):
    docs = request.getfixturevalue(table)
    got = packing.pack(docs, capacity=capacity, windows=8).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(x)) for r, x in zip(rows, encoded([r.text or "" for r in rows])))
    # Rows of one id are told apart by their ids; here they have the same text.
    ids, placed = defaultdict(list), defaultdict(list)
    for r in got:
        piece = np.frombuffer(r.ids, "<u4")
        assert len(piece) == r.length > 0
        ids[r.doc_id].append((r.start, tuple(piece), r.doc_tokens))
        placed[r.sequence_id].append((r.offset, r.length))
    for (doc_id, tokens), n in want.items():
        seen = Counter()
        for start, piece, total in ids[doc_id]:
            assert tokens[start : start + len(piece)] == piece and total == len(tokens)
            seen.update(range(start, start + len(piece)))
        assert seen == Counter({k: n for k in range(len(tokens))})
    room = 0
    for cells in placed.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= capacity
        room += capacity - at if at & (at - 1) else 0
    assert room <= 0.01 * sum(r.length for r in got)


def test_differencing_evens_out_and_windows_rise_beyond_the_capacity():
    sums, filled = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16]  # the textbook's result, not the best one
    assert sorted(i for x in filled for i in x) == [0, 1, 2, 3, 4]
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        for windows in (1, 3, 10):
            sums, filled = packing.differencing(sizes, windows)
            assert [sum(sizes[i] for i in x) for x in filled] == sums.tolist()
            assert sorted(i for x in filled for i in x) == list(range(len(sizes)))
            if len(sizes) >= 10 * windows:
                assert max(sums) - min(sums) <= 20
        found = packing.windows_for(sizes, 100)
        assert max(sum(sizes[i] for i in x) for x in found) <= 100
    assert packing.windows_for([60, 60, 60], 100) == [[0], [1], [2]] or len(packing.windows_for([60, 60, 60], 100)) == 3


def test_sequences_are_padded_but_at_powers_of_two(documents):
    pieces = packing.pack(documents, capacity=64, windows=8)
    for r in packing.sequences(pieces, 64, pad=7).collect():
        ids = np.frombuffer(r.ids, "<u4")
        whole = r.n_tokens & (r.n_tokens - 1) == 0
        assert len(ids) == (r.n_tokens if whole else 64) and (ids[r.n_tokens :] == 7).all()
        assert sum(x.length for x in r.documents) == r.n_tokens


def test_nothing_is_packed_from_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0


# Divergence


def plain_divergence(rows, top=200):
    words = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        found = words.findall((r.text or "").translate(LOWER))
        counts[r.lang or "", r.source or ""].update(found)
        docs[r.lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        groups = sorted(g for g in counts if g[0] == lang)
        total = {g: sum(counts[g][t] for t in kept) for g in groups}
        p = {g: {t: 1 + 10**9 * (counts[g][t] + 1) // (total[g] + len(kept)) for t in kept} for g in groups}
        q = {t: 1 + 10**9 * (sum(counts[g][t] for g in groups) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for g in groups:
            pairs = sorted((-sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h[1].encode()) for h in groups if h != g)
            terms = sorted((-((p[g][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[g][t] and p[g][t] > q[t])[:top]
            out |= {(*g, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [12 << 20, 64])
def test_divergence_is_that_of_plain_code(odd, documents, block, monkeypatch):
    real = divergence.word_counts
    monkeypatch.setattr(divergence, "word_counts", lambda df: real(df, block_bytes=block))
    for docs in (odd, documents) if block > 64 else (odd,):
        got = [tuple(r) for r in divergence.divergence(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_divergence(docs.collect())


def test_divergence_joins_totals_of_many_groups(odd):
    few = sorted(map(str, divergence.divergence(odd, top=2).collect()))
    assert few == sorted(map(str, divergence.divergence(odd, top=2, most_groups=0).collect()))


def test_counts_that_fill_long_are_exact(spark):
    row = spark.createDataFrame([(3_000_000_000_000_000, 7_000_000_000_000_001)], "c long, m long")
    got = row.selectExpr(divergence.probability("c", "m")).first()[0]
    assert got == 1 + 10**9 * 3_000_000_000_000_000 // 7_000_000_000_000_001
    assert divergence._probabilities(np.array([3_000_000_000_000_000]), np.array([7_000_000_000_000_001])).tolist() == [got]


def test_divergence_of_nothing_is_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOC)).count() == 0


# Spelling


def plain_variants(rows, least=5, times=5):
    counts = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    n = {w: k for w, k in counts.items() if k >= least and len(w) >= 6}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: x for w in n if near[w] and n[x := min(near[w], key=lambda y: (-n[y], y))] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("most", [50_000, 30])
def test_variants_are_those_of_plain_code(documents, most):
    """Also where partitions are cut further, down to the rests of words."""
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(documents, most=most).collect()]
    want = plain_variants(documents.collect())
    assert len(got) == len(want) and set(got) == want and any(x[1] for x in want)


@pytest.mark.parametrize("most", [50_000, 1])
def test_runs_of_letters_ties_and_chains(spark, most):
    words = Counter({"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaab": 30, "baaaaaa": 30, "abcdef": 5, "abcdefg": 6, "xbcdef": 5, "abcxef": 25, "abcyef": 25, "ÿbcdef": 5, "short": 99, "lonely word"[:6]: 7})
    words[("long" * 3)[:-1]], words["long" * 3] = 5, 26
    rows = [(k, " ".join([w] * n), None, None, 1, 1, "x") for k, (w, n) in enumerate(words.items())]
    rows += [(None, "null as an id", None, None, 1, 1, "x"), (77, None, None, None, 1, 1, "x"), (78, "", None, None, 1, 1, "x")]
    docs = spark.createDataFrame(rows, DOC)
    got = {tuple(r) for r in spelling.variants(docs, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(docs.collect())


def test_long_texts_are_cut_between_words(documents):
    small = sorted(map(tuple, spelling.vocabulary(documents, block_bytes=50).collect()))
    assert small == sorted(map(tuple, spelling.vocabulary(documents).collect()))


def test_no_variants_without_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0


def test_registered_queries_have_the_contracts_columns(spark):
    columns = {
        "op11_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op12_divergence": {"lang", "source", "part", "item", "value", "rank"},
        "op13_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
    }
    for name, want in columns.items():
        df = queries.QUERIES[name](spark, SF)
        assert want <= set(df.columns)
        kinds = dict(df.dtypes)
        assert all(kinds[c] in ("bigint", "string", "int") for c in want)
    packed = queries.QUERIES["op11_packing"](spark, SF).filter("start = 0 AND length = doc_tokens").orderBy("doc_id").limit(20).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin([r.doc_id for r in packed])).collect()}
    for r, ids in zip(packed, encoded([texts[r.doc_id] or "" for r in packed])):
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())

"""Operators on single texts: against libraries, plain regular expressions and round trips."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import bytehash, langid, pieces, pii, quality
from tracelake.llm.chat import format_turns, read_back, read_turn, text_parts
from tracelake.llm.decontaminate import drop_contaminated, overlaps
from tracelake.llm.langid import fit, identify, keep_identified, predict
from tracelake.llm.tokens import count_tokens

SCHEMA = "doc_id long, text string, n_tokens string, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_identifiers_match_plain_patterns():
    rnd = random.Random(1)
    for _ in range(20000):
        text = "".join(rnd.choice("a1.2@-+ (2)5x0.@é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write john [at] mail dot example dot com now", "john [at] mail dot example dot com"),
        ("j.doe (at) foo.bar (dot) org", "j.doe (at) foo.bar (dot) org"),
        ("ｊｏｈｎ＠example．com", "ｊｏｈｎ＠example．com"),
        ("x jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("call +１ (234) 555-0199 x", "+１ (234) 555-0199"),
        ("call plus one two three, four five six seven eight nine zero one now", "plus one two three, four five six seven eight nine zero one"),
        ("x four five five six seven three seven five eight six eight nine nine eight five five y", "four five five six seven three seven five eight six eight nine nine eight five five"),
        ("at 10 dot 0 dot 0 dot 1.", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_disguises_map_back_to_the_source(text, found):
    base, every = pii.spans(text)
    assert base == [] and [text[a:b] for a, _, b in every] == [found]


@pytest.mark.parametrize("text", ["look at example.com", "we met at home and dot it was", "see me at 5. one two three", "un deux", "Дом 7", ""])
def test_clean_texts_have_no_spans(text):
    assert pii.spans(text) == ([], [])


def test_pii_queries(spark):
    df = frame(spark, ["a@b.co and c [at] d dot ee", None, "", "x " * 70000 + "1.2.3.4", "a@b.co"])
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert rows[0]["spans"] == "email:0:6,email:11:26" and (rows[0]["n_email"], rows[0]["n_added"]) == (1, 1)
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
    assert rows[1]["spans"] == rows[2]["spans"] == "" and rows[3]["n_ip"] == 1
    assert [r["text"] for r in pii.redact(df.orderBy("doc_id")).collect()][:3] == ["<EMAIL> and <EMAIL>", None, ""]
    assert pii.find(df.limit(0)).count() == 0


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    with open(pieces.default_model(), "rb") as file:
        machine = pieces.Machine(file.read())
    rnd = random.Random(2)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCé ▁\n日本你好.,!?0123456789", "  ", "     ", "th", "ing", "한국", "🙂", "\x00", "the", "ation", "aaaa", "----"]
    texts = [None, "", " ", "\n"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    for t in texts:
        ids = machine.encode(t).tolist()
        assert ids == sp.encode(t or "")
        assert machine.decode(ids) == (t or "").replace("▁", " ")
    df = frame(spark, texts[:50] + ["word " * 30000])
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df), to="back").collect()}
    assert all(rows[i]["ids"] == sp.encode(t or "") and rows[i]["back"] == (t or "").replace("▁", " ") for i, t in enumerate(texts[:50]))
    assert pieces.digests(df.limit(0)).count() == 0


def test_unigram_takes_the_cheapest_path():
    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    import struct

    vocabulary = [("<unk>", 0.0, 2), ("▁", -4.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("▁a", -1.0, 1), ("▁ab", -9.0, 1)]
    model = b"".join(field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for t, s, k in vocabulary) + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")
    machine = pieces.Machine(model)
    assert [machine.texts[k] for k in machine.encode("ab")] == ["▁a", "b"]
    assert machine.encode("z").tolist() == [1, 0]


def test_token_counts_with_chunks(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    bits = ["a", "the ", "  ", "\n\n", "é", "日本", "'s", "'re", "123", "<|endoftext|>", "<|end", "!!", "x" * 50, " " * 40]
    texts = [None, "", "a" * 3000, " " * 3000, "ab " * 1000, "<|endoftext|>" * 300] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400))) for _ in range(25)]
    df = frame(spark, texts)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    for chunk, overlap in ((1 << 16, 1 << 10), (64, 16)):
        rows = count_tokens(df, chunk=chunk, overlap=overlap).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in rows)
    assert count_tokens(df.limit(0)).count() == 0


def test_overlaps_survive_substitutions(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 30, 6)] + [[]]
    clean = [[word() for _ in range(100)] for _ in range(6)]
    changed = list(items[0])
    for k in range(5, 40, 9):
        changed[k] = word()
    texts = [clean[0] + items[0] + clean[1], clean[2] + [w.upper() + "," for w in changed] + clean[3], clean[4], items[1][:20] + clean[5], clean[0][:9] + items[2]]
    docs = frame(spark, [" ".join(x) for x in texts] + [None, "", " ".join(items[1])])
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    want = {(0, 0), (1, 0), (3, 1), (4, 2), (7, 1)}
    for limit in (20_000, 0):
        found = overlaps(docs, bench, broadcast_items=limit)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [2, 5, 6]
    assert overlaps(docs, bench.limit(0)).count() == 0 and overlaps(docs.limit(0), bench).count() == 0


def test_texts_are_hashed_together_each_by_itself(spark, monkeypatch):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abZ é9,. ") for _ in range(rnd.choice((0, 1, 5, 300)))) for _ in range(500)] + ["x" * 70, "", "a" * 30 + " b"]

    def plain(text):
        out = []
        for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
            h = 0
            for c in re.sub(rb"[A-Z]", lambda m: m[0].lower(), token):
                h = (h * bytehash.BASE + c + 1) % 2**64
            out.append(h ^ len(token) << 56)
        return bytehash.mix(np.array(out, np.uint64)).tolist()

    for size, most in ((1 << 18, 1), (1000, 500), (20, 600)):
        monkeypatch.setattr(bytehash, "TOGETHER", size)
        groups = list(bytehash.hashes_by_text(pa.array(["before", *texts]).slice(1)))
        assert len(groups) <= most
        assert [(row + k, tokens[first[k] : first[k + 1]].tolist()) for row, tokens, first in groups for k in range(len(first) - 1)] == [(i, plain(t)) for i, t in enumerate(texts)]
    assert [bytehash.token_hashes(t.encode()).tolist() for t in texts] == [plain(t) for t in texts]
    item = [f"w{k}" for k in range(16)]
    docs = frame(spark, [" ".join(item[:8]), " ".join(item[8:]), " ".join(item[:8]), "", " ".join(item[8:]), " ".join(item[:12])]).coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item * 2))], "item_id long, text string")
    for limit in (20_000, 0):
        assert [r["doc_id"] for r in overlaps(docs, bench, broadcast_items=limit).collect()] == [5]


def test_chat_reads_back_what_was_written(spark):
    turns = [(1, 0, "user", "hi\n### x"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "sys\ntem", "<image 0>"), (3, 0, "assistant", "x" * 100000)]
    turns += [(4, 0, "user", "#a"), (4, 0, "user", "A"), (4, 0, "a#", "z"), (4, 0, "ab", "y")]  # equal turns go by role and text, not as they are escaped
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = format_turns(df.withColumn("parts", text_parts(F.col("text"))))
    rows = {r["conv_id"]: r for r in read_back(formatted).collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert rows[1]["turns_sha256"] == digest("user\nhi\n### x\nassistant\n\\### Assistant: </turn> ok\nassistant\nb\n")
    assert rows[1]["loss_sha256"] == digest("\\### Assistant: </turn> okb") and rows[1]["loss_chars"] == 27
    assert rows[2]["turns_sha256"] == digest("\n\n") and rows[None]["turns_sha256"] == digest("sys\ntem\n<image 0>\n")
    assert rows[1]["formatted_chars"] == sum(len(r["formatted"]) for r in formatted.filter("conv_id = 1").collect())
    assert rows[3]["loss_chars"] == 100000
    assert rows[4]["turns_sha256"] == digest("a#\nz\nab\ny\nuser\n#a\nuser\nA\n")
    assert read_back(formatted.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    parts = "array<struct<type: string, text: string, ref: string, n_tokens: long>>"
    row = (1, 0, "user", [("text", "see <b>", None, None), ("image", None, "s3://x", 7), ("text", " and ", None, None), ("audio", None, "y", None)])
    formatted = format_turns(spark.createDataFrame([row, (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {parts}"))
    first = formatted.filter("turn = 0").first()
    assert first["formatted"] == "### user\nsee \\<b> and <audio 1>\n</turn>\n".replace(" and ", "<image 0> and ")
    assert [(a["number"], a["type"], a["ref"], a["n_tokens"]) for a in first["attachments"]] == [(0, "image", "s3://x", 7), (1, "audio", "y", 1)]
    assert read_turn(first["formatted"]) == ("user", "see <b><image 0> and <audio 1>")
    total = read_back(formatted).first()
    assert (total["n_attachments"], total["attachment_tokens"]) == (2, 8)


def test_language_of_held_out_texts(spark):
    rnd = random.Random(8)
    words = {x: [x + "".join(rnd.choice(a) for _ in range(5)) for _ in range(200)] for x, a in (("en", "thewrd"), ("fr", "éouairle"))}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(30)), x) for i in range(120) for x in ([*words][i % 2],)]
    rows += [(200, None, "en"), (201, "12 34 !", None), (202, "", "fr"), (203, " ".join(words["fr"]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:120]) and got[203]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert {r["doc_id"] for r in keep_identified(df).collect()} == {*range(120), 203}
    assert identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_matches_plain_code(spark):
    """The model and its scores by counting in plain code, on words beyond any table and on texts without letters."""
    rnd = random.Random(18)
    pools = {"de": "abcdeß", "nl": "abcdeij"}
    words = {x: ["".join(rnd.choice(a) for _ in range(rnd.randint(1, 9))) for _ in range(60)] + [x * 40] for x, a in pools.items()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(12)), x) for i in range(40) for x in ([*pools][i % 2],)]
    odd = ["½ ² Ⅷ", "12_3", "é", "ab½cd", "x" * 300, "DE" * 40, "…", "zzz qqq", "a" * 70 + " " + "b"]
    df = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    model = fit(df, "doc_id", "text", "lang")
    counts, grams = Counter(), Counter()
    for _, t, x in rows:
        for w in t.split():
            counts[w, x] += 1
            for n in range(1, 6):
                for i in range(len(w) + 2 - n + 1):
                    grams[f"<{w}>"[i : i + n], x] += 1

    def logs(table, keys):
        sums = {x: sum(table[k, x] for k in keys) for x in pools}
        scaled = {x: {k: table[k, x] / sums[x] * max(sums.values()) + 0.5 for k in keys} for x in pools}
        return {k: [math.log(scaled[x][k] / sum(scaled[x].values())) for x in sorted(pools)] for k in keys}

    known = logs(counts, {w for w, _ in counts})
    by_length = {n: logs(grams, {g for g, _ in grams if len(g) == n}) for n in range(1, 6)}

    def word(w):
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            hits = [h for i in range(len(w) + 2 - n + 1) if (h := by_length[n].get(f"<{w}>"[i : i + n]))]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits)]
        return [0.0, 0.0]

    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", predict(df, model).alias("p")).collect()}
    for i, t in [(i, t) for i, t, _ in rows] + [(100 + i, t) for i, t in enumerate(odd)]:
        total = [0.0, 0.0]
        found = regex.findall(r"\p{L}+", t.lower())
        for w in found:
            total = [a + b for a, b in zip(total, word(w))]
        if not found:
            assert tuple(got[i]) == ("und", 0.0), t
        else:
            best = total.index(max(total))
            assert got[i]["lang"] == sorted(pools)[best], t
            assert abs(got[i]["score"] - 1 / sum(math.exp(x - total[best]) for x in total)) < 1e-9, t


def plain_metrics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_metrics_match_plain_code(spark):
    rnd = random.Random(9)
    pool = ["a", "b", "cc", "é", "#", "\n", "\n\n", "\t", "word", "|"]
    texts = [None, "", "a b", " ", "\n\n", "a b c " * 40] + [" ".join(rnd.choice(pool[: rnd.randint(2, 10)]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    texts.append(" ".join(str(i % 900) for i in range(1800)))  # many different repeated windows
    texts.append(" ".join(str(i % 5000) for i in range(10000)))  # more than are looked up one by one
    rows = {r["doc_id"]: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        assert tuple(rows[i][m] for m in quality.METRICS) == plain_metrics(t), t
    assert rows[len(texts) - 1]["n_repeat_words"] == 10000
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows.values())
    assert not any(r["kept"] and r["base_failed"] for r in rows.values())
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_keeps_prose_and_drops_symbols(spark):
    rnd = random.Random(10)
    prose = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(150)) + "." for _ in range(80)]
    junk = [" | ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(150)) + "." for _ in range(20)]
    kept = {r["doc_id"] for r in quality.judge(frame(spark, prose + junk)).filter("kept").collect()}
    assert kept == set(range(80))


def test_quality_keeps_one_weak_flag_among_good_votes(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line = lambda n, end: " ".join(word() for _ in range(n)) + end
    prose = ["\n".join(line(15, ".") for _ in range(10)) for _ in range(80)]
    lists = ["\n".join(line(15, "") for _ in range(10)) for _ in range(4)] + ["\n".join(line(6, "") for _ in range(10)) for _ in range(4)]
    junk = ["\n".join(" | ".join(str(rnd.randint(0, 9)) for _ in range(20)) for _ in range(10)) for _ in range(12)]
    rows = {r["doc_id"]: r for r in quality.judge(frame(spark, prose + lists + junk)).collect()}
    assert all(sum(rows[i][f"vote_{k}"] < 0 for k in quality.rules()) == 1 for i in range(80, 88))
    assert {i for i, r in rows.items() if r["kept"]} == set(range(88))


def test_estimates_match_plain_expectation_maximisation(spark):
    rnd = random.Random(19)
    names = ["a", "b", "c"]
    rows = []
    for _ in range(400):
        good = rnd.random() < 0.7
        rows.append(tuple(rnd.choices((1, 0, -1), (0.6, 0.3, 0.1) if good else (0.1, 0.2, 0.7) if k < 2 else (0.3, 0.4, 0.3))[0] for k in range(3)))
    prior, weights = quality.estimate(spark.createDataFrame(rows, "_v_a int, _v_b int, _v_c int"), names)

    p = [1.0 if min(r) >= 0 else (r.count(1) + 1) / (r.count(1) + r.count(-1) + 2) for r in rows]
    before = None
    for _ in range(50):
        share = (sum(p) + 1) / (len(rows) + 2)
        rate = {(k, v, g): (sum(w for r, w in zip(rows, side) if r[k] == v) + 2 / 3) / (sum(side) + 2) for g, side in ((1, p), (0, [1 - x for x in p])) for k in range(3) for v in (-1, 0, 1)}
        if before and max(abs(rate[x] - before[x]) for x in rate) < 1e-4:
            break
        before = rate
        odds = [math.log(share / (1 - share)) + sum(math.log(rate[k, r[k], 1] / rate[k, r[k], 0]) for k in range(3)) for r in rows]
        p = [1.0 if min(r) >= 0 else 1 / (1 + math.exp(-x)) for r, x in zip(rows, odds)]
    assert abs(prior - share) < 1e-6
    for k, name in enumerate(names):
        assert all(abs(weights[name][v + 1] - math.log(rate[k, v, 1] / rate[k, v, 0])) < 1e-6 for v in (-1, 0, 1))


# What is planted: the kind, the plain identifier, and how it can be disguised.
DISGUISES = {
    "email": ("ann.lee{n}@mail{n}.example.com", {"brackets": lambda x: x.replace("@", " [at] ").replace(".", " [dot] "), "words": lambda x: x.replace("@", " at ").replace(".", " dot "), "cyrillic": lambda x: x.replace("a", "а").replace("e", "е"), "wide": lambda x: "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in x), "upper": lambda x: x.replace("@", " (AT) ").replace(".", " (DOT) ")}),
    "ip": ("10.{n}.0.{n}", {"words": lambda x: x.replace(".", " dot "), "brackets": lambda x: x.replace(".", "[.]"), "wide": lambda x: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in x)}),
    "phone": ("+1 555 010 {n:04d}", {"spelled": lambda x: " ".join(["plus", *(SPELLED[int(c)] for c in x if c.isdigit())]), "mixed": lambda x: x.replace("555", "five five five"), "wide": lambda x: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in x), "german": lambda x: " ".join(["plus", *(GERMAN[int(c)] for c in x if c.isdigit())])}),
    "card": ("4556737586899855", {"spelled": lambda x: " ".join(SPELLED[int(c)] for c in x), "dashed": lambda x: "–".join(x[i : i + 4] for i in range(0, 16, 4)), "upper": lambda x: " ".join(GERMAN[int(c)].upper() for c in x)}),
}
SPELLED = "zero one two three four five six seven eight nine".split()
GERMAN = "null eins zwei drei vier fünf sechs sieben acht neun".split()


@pytest.mark.parametrize(("kind", "way"), [(k, w) for k, (_, ways) in DISGUISES.items() for w in ways])
def test_planted_disguises_are_found_and_prose_is_left_alone(kind, way):
    rnd = random.Random(20)
    words = "the cat sat at home and looked on with one eye or two while seven dots of rain fell plus some more".split()
    caught = 0
    for n in range(100, 150):
        plain, disguised = DISGUISES[kind][0].format(n=n), DISGUISES[kind][1][way](DISGUISES[kind][0].format(n=n))
        before = " ".join(rnd.choice(words) for _ in range(8)) + " | "
        text = before + disguised + " | " + " ".join(rnd.choice(words) for _ in range(8))
        spans = [(a, k, b) for a, k, b in pii.spans(text)[1] if k == pii.KINDS.index(kind)]
        caught += any(a <= len(before) and b >= len(before) + len(disguised) for a, _, b in spans)
        assert all(a >= len(before) and b <= len(before) + len(disguised) for a, _, b in spans), (text, plain)
    assert caught == 50


def test_a_long_local_part_with_spelled_dots_is_found_whole():
    local = " dot ".join(["part"] * 60)
    text = f"so {local} at mail dot example dot com it is"
    assert [text[a:b] for a, _, b in pii.spans(text)[1]] == [f"{local} at mail dot example dot com"]


@pytest.mark.parametrize(
    ("text", "fragment", "whole", "clean"),
    [
        ("x jоhn@example.com y", "hn@example.com", "jоhn@example.com", "x <EMAIL> y"),
        ("x john@example.cоm y", "john@example.c", "john@example.cоm", "x <EMAIL> y"),
        ("x +1 234 555 019９ y", "+1 234 555 019", "+1 234 555 019９", "x <PHONE> y"),
    ],
)
def test_disguises_that_leave_a_base_fragment(text, fragment, whole, clean):
    base, every = pii.spans(text)
    assert [text[a:b] for a, _, b in base] == [fragment]
    assert {text[a:b] for a, _, b in every} == {fragment, whole} and len(every) == 2
    assert pii.redacted(text) == clean


def test_no_overlap_that_counts_is_missed(spark):
    """Against all segments of all alignments, over items of 1 to 30 tokens and substitutions."""
    rnd = random.Random(12)
    numbers = iter(range(10**6))
    fresh = lambda: f"w{next(numbers)}"
    items = [[fresh() for _ in range(n)] for n in [*range(1, 31), 64]]
    texts = [items[-1][:12] + [w if k % 4 else fresh() for k, w in enumerate(items[-1][12:])]]  # a looser overlap around the first 12
    texts += [[w if k % 4 != 3 else fresh() for k, w in enumerate(items[-1][:15])] + [fresh()] * 3]  # runs of three
    for item in items[:-1] * 8:
        cut = rnd.randint(0, len(item) // 2)
        texts.append([fresh()] + [fresh() if rnd.random() < rnd.choice((0.05, 0.2, 0.3)) else w for w in item[cut:]] + [fresh()])

    def counts(doc, item):
        least = min(10, max(1, -(-len(item) // 2)))
        for shift in range(-len(item) + 1, len(doc)):
            a, b = max(0, -shift), min(len(item), len(doc) - shift)
            sums = [0]
            for k in range(a, b):
                sums.append(sums[-1] + (doc[k + shift] == item[k]))
            if any(sums[j] - sums[i] >= least and 5 * (sums[j] - sums[i]) >= 4 * (j - i) for j in range(len(sums)) for i in range(j)):
                return True
        return False

    want = {(d, i) for d, doc in enumerate(texts) for i, item in enumerate(items) if set(doc) & set(item) and counts(doc, item)}
    assert {(0, 30), (1, 30)} <= want
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for limit in (20_000, 0):
        found = overlaps(frame(spark, [" ".join(x) for x in texts]), bench, broadcast_items=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want
        assert all(5 * r["matched_tokens"] >= 4 * r["overlap_tokens"] for r in found)


def test_a_rare_language_is_learned_beside_a_large_one(spark):
    rnd = random.Random(13)
    words = {x: ["".join(rnd.choice(a) for _ in range(6)) for _ in range(150)] for x, a in (("en", "thewrdsn"), ("is", "thewrdsnæ"))}
    rows = [(i, " ".join(rnd.choice(words["en"]) for _ in range(20)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(rnd.choice(words["is"]) for _ in range(20)), "is") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, "doc_id", "text", "lang", 60)
    assert model.languages == ["en", "is"]
    seen = sorted({w for r in rows[3000:] for w in r[1].split()})
    assert set(langid._hashes(seen).tolist()) <= set(model.words.tolist())
    got = df.withColumn("p", predict(df, model)["lang"])
    assert got.filter("p != lang").count() == 0

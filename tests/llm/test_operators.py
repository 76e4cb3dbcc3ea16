"""Each text operator against a brute-force version, and its defined odd cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

from netloom.llm import bpe, common, decontam, langid, linededup, minmax, pii, queries, repeats, rules, toolcalls, toxicity
from netloom.llm.common import held_out

SCHEMA = "doc_id bigint, text string, lang string, source string, body string, words string, score double"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names the operators use themselves."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, l, None, "b", None, 0.5) for i, (t, l) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n ", "Tie tie tie", "Tie tie tie", "é\x85　漢字 \x1c x'll  y\n\n z's'", "a" * 5000, "1 2\r\n3   "]


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def random_texts(rng, n, vocabulary=60, longest=120):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(vocabulary)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]
    for i in range(n // 3):  # copies with an edit
        t = texts[rng.randrange(n)].split(" ")
        t[rng.randrange(len(t))] = "edit"
        texts.append(" ".join(t) + rng.choice(["", " tail", "\nA line that some of the documents share"]))
    return texts


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_pre_tokens_match_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabet = " \n\t'strevlmdLL12é漢!?- \x85\x1c"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "don't we'll 's ''s"]
    joined, _, starts, ends, counts = bpe.pre_tokens(texts)
    found = [joined[a:b] for a, b in zip(starts, ends)]
    at = 0
    for text, n in zip(texts, counts):
        assert found[at : at + n] == pattern.findall(text), text
        at += n


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_bpe_matches_tiktoken(spark, block_bytes):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = [*ODD, *random_texts(random.Random(2), 30), "Hello wörld <|endoftext|> 12345"]
    coded = bpe.encode(docs(spark, texts), RANKS, block_bytes=block_bytes, part_bytes=500)
    rows = by_id(bpe.decode(coded, RANKS))
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].ids == own.encode_ordinary(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()


def thue_morse(order, zero, one):
    word = [zero]
    for _ in range(order):
        word += [one if c == zero else zero for c in word]
    return "".join(word)


ALIKE = [thue_morse(11, "a", "b"), thue_morse(11, "b", "a")]


@pytest.mark.parametrize("parts", [1, 2])
def test_words_that_a_polynomial_confuses(spark, parts):
    frame = docs(spark, [*ALIKE, *ALIKE]).repartition(parts, "doc_id")
    rows = by_id(bpe.decode(bpe.encode(frame, RANKS), RANKS))
    assert [bytes(rows[i].decoded).decode() for i in range(4)] == [*ALIKE, *ALIKE]
    groups = by_id(minmax.near_duplicates(frame))
    assert [groups[i].component_id for i in range(4)] == [0, 1, 0, 1]


def test_words_whose_fingerprints_meet(monkeypatch):
    monkeypatch.setattr(common, "span_hashes", lambda symbols, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    words, number, counts = bpe.numbered_words(["ab ac ad ab", "", " ac ad"])
    assert [words[n] for n in number] == ["ab", " ac", " ad", " ab", " ac", " ad"] and len(words) == 4
    assert counts.tolist() == [4, 0, 2]


def test_long_texts_in_pieces(monkeypatch):
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(15)
    text = "".join(rng.choices(" \n\tab'sé1?漢\x1c\x85 ", k=4000))
    pieces = list(common.text_pieces(text, bpe.SAFE_BREAK, 50))
    assert "".join(pieces) == text and len(pieces) > 5
    assert [m for p in pieces for m in pattern.findall(p)] == pattern.findall(text)


def test_line_dedup(spark):
    shared = "A Line that is Shared by many"
    texts = [*ODD, f"one\n{shared}\n{shared}", f"  {shared.upper()}\t\ntwo", f"{shared}\nthree", "short\nshort", "short", "short"]
    rows = by_id(linededup.drop_repeated_lines(docs(spark, texts)))
    lines = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    key = lambda s: low(s).strip(" \t\n\x0b\x0c\r")
    holders = {}
    for i, own in lines.items():
        for k in {key(x) for x in own}:
            holders.setdefault(k, set()).add(i)
    for i, own in lines.items():
        keep = [x for x in own if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].clean_text) == (len(own), len(own) - len(keep), "\n".join(keep))
    assert rows[8].clean_text == "one" and rows[8].n_dropped == 2


@pytest.mark.parametrize("block", [128, 4])
def test_near_duplicates(spark, block):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [*ODD, *random_texts(rng, 20)]
    for _ in range(40):  # one large group of unlike copies
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(t))
    rows = by_id(minmax.near_duplicates(docs(spark, texts), block=block, anchors=2))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and root[i] != root[j]:
                top, keep = max(root[i], root[j]), min(root[i], root[j])
                root = [keep if r == top else r for r in root]
    for i, s in enumerate(sets):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(s), root[i], root[i] == i), i


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (5, 5)], "a bigint, b bigint")
    found = {r.v: r.label for r in minmax.components(edges).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), 200: 200, 201: 200}


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_decontamination(spark, block_bytes):
    rng = random.Random(4)
    texts = [*ODD, *random_texts(rng, 25)]
    items = [None, "", "!!", "Tie", "x y", *(" ".join(t.split()[3:20]) for t in texts[8:20]), "é\x85"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    rows = by_id(decontam.find_benchmark(docs(spark, texts), bench, block_bytes=block_bytes))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in enumerate(items):
        w = word.findall(low(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for i, t in enumerate(texts):
        w = word.findall(low(t or ""))
        hit, who = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    who |= own
                    hit |= set(range(k, k + size))
        assert rows[i].n_words == len(w) and rows[i]["items"] == sorted(who), t
        assert {x for s in rows[i].spans for x in range(s.start, s.end)} == hit


@pytest.mark.parametrize("bucket", [32_768, 0])
def test_repeats(spark, bucket):
    rng = random.Random(5)
    piece = "".join(rng.choices("abc é", k=300))
    texts = [*ODD, *("".join(rng.choices("abcd ", k=rng.randint(0, 500))) for _ in range(12))]
    texts += [texts[9] + piece[:250] + texts[10], piece[20:] + "z", piece + piece, "ab" * 400]
    rows = by_id(repeats.remove_repeats(docs(spark, texts), max_bucket=bucket))
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept_bytes)) == (len(t), gone.sum(), runs, kept), i


def test_language(spark):
    rng = random.Random(6)
    letters = {"aa": "abcd", "bb": "efgh", "cc": "zéxw"}
    texts, langs = [], []
    for i in range(90):
        lang = "abc"[i % 3] * 2
        texts.append(" ".join("".join(rng.choices(letters[lang] + "o", k=4)) for _ in range(20)))
        langs.append(lang)
    frame = docs(spark, [*texts, *ODD], langs + [None] * len(ODD))
    frozen = langid.train(frame.filter(~held_out(frame.doc_id)))
    rows = by_id(langid.identify(frame, frozen))
    assert all(rows[i].lang_pred == lang and 0.5 < rows[i].score <= 1 for i, lang in enumerate(langs))
    assert [rows[90 + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[97].lang_pred == "und"
    # Probabilities of a context sum to one, so lengths are those of a code.
    model = langid.Model(frozen)
    assert np.allclose((2.0 ** -model.cost.reshape(-1, 256, 3).astype(float)).sum(axis=1), 1, atol=1e-3)
    empty = langid.identify(frame, langid.train(frame.filter("lang = 'none'")))
    assert {r.lang_pred for r in empty.collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(200)]
    label = [i % 4 == 0 for i in range(200)]
    texts = [t + rng.choice([" badword", " nastything", " badwordish"]) * bad for t, bad in zip(texts, label)]
    frame = docs(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(label)] + [(3, 1, None), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = by_id(toxicity.score(frame, toxicity.fit(frame, labels, ~held_out(frame.doc_id))))
    assert all((rows[i].score >= 0.5) == b for i, b in enumerate(label))
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 208
    none = toxicity.score(frame, toxicity.fit(frame, labels.filter("toxic = 0"), ~held_out(frame.doc_id)))
    assert {r.score for r in none.collect()} == {0.0}


def test_toxicity_of_two_lexicons(spark):
    """Toxic texts of a large and a small lexicon are found: unanchored rounds lose one of them."""
    rng = random.Random(11)
    texts, label, small = [], [], []
    for letters, bad_words, size in (("abcdefgh", ("badword", "nastything"), 400), ("stuvwxyz", ("schlimm", "uebelwort"), 80)):
        plain = ["".join(rng.choices(letters, k=6)) for _ in range(150)]
        for i in range(size):
            bad = i % 8 == 0
            # Some clean texts of the second lexicon hold its words as well.
            slip = letters[0] == "s" and i % 8 == 1
            words = rng.choices(plain, k=30) + ([rng.choice(bad_words)] if slip else list(bad_words) if bad else [])
            texts.append(" ".join(rng.sample(words, len(words))))
            label.append(int(bad))
            small.append(letters[0] == "s")
    frame = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id bigint, toxic int")
    rows = by_id(toxicity.score(frame, toxicity.fit(frame, labels, ~held_out(frame.doc_id))))
    for part in (False, True):
        own = [i for i, s in enumerate(small) if s == part]
        toxic = [i for i in own if label[i]]
        assert sum(rows[i].score >= 0.5 for i in toxic) >= 0.8 * len(toxic), part
        assert sum(rows[i].score >= 0.5 for i in own if not label[i]) <= 0.05 * len(own), part


def test_quality_rules(spark):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(70)) for _ in range(60)]
    bad = [g.replace(" ", "## ") for g in good[:40]]
    texts = [*good, *bad, *ODD, "a b c d a b c", "x\nx\n\nx"]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(1, None, 0)], "doc_id bigint, quality int, toxic int")
    counts = rules.text_counts(frame)
    learned = rules.learn_list(rules.labelled_counts(counts, labels, counts.doc_id >= 0, counts.doc_id % 3 == 0))
    rows = by_id(rules.judge(counts, learned))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {x for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for x in range(k, k + 3)}
        full = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert all(rows[i].kept for i in range(60)) and not any(rows[i].kept for i in range(60, 100))
    assert rules.learn_list(rules.labelled_counts(counts, labels.filter("quality = 1"), counts.doc_id >= 0, counts.doc_id < 0)) == []


def test_personal_data(spark):
    text = "mail a@b@c.de_f@g.hi 1.2.3.4.5.6.7.8 256.1.1.1 card 4111 1111-1111 1111 +1 (424) 555-6469 +12 34"
    rng = random.Random(9)
    many = [f"{''.join(rng.choices('abcdef ', k=40))} +1 (4{i:02}) 555-01{i:02} and x{i}@h{i}.example.org {i}.2.3.4 end" for i in range(40)]
    rows = by_id(pii.find(frame := docs(spark, [*ODD, text, *many]), pii.train(frame, steps=40)))
    found = [(text[s.start : s.end], s.kind) for s in rows[8].base]
    assert found == [
        ("b@c.de", "email"), ("_f@g.hi", "email"), ("1.2.3.4", "ip"), ("5.6.7.8", "ip"),
        ("4111 1111-1111 1111", "card"), ("+1 (424) 555-6469", "phone"),
    ]
    for r in rows.values():
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert [len(rows[i].spans) for i in range(3)] == [0, 0, 0]


def planted_forms(rng, n):
    """Texts with one value each in a form that no pattern matches: (text, start, end, kind)."""
    words = ["the", "order", "of", "house", "call", "write", "please", "number", "network", "paid", "and", "server", "our", "with"]
    out = []
    for i in range(n):
        kind = pii.KINDS[i % 4]
        d = lambda k: "".join(rng.choices("0123456789", k=k))
        name = "".join(rng.choices("abcdefghij", k=6))
        card = "4" + d(14)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        value = {
            "email": f"{name}.{name[:3]}@{name[::-1]}.org", "ip": ".".join(str(rng.randint(1, 254)) for _ in range(4)),
            "card": card, "phone": f"+{rng.randint(1, 9)} ({d(3)}) {rng.randint(100, 999)}-{d(4)}",
        }[kind]
        before, after = (" ".join(rng.choices(words, k=rng.randint(4, 12))) for _ in range(2))
        out.append((before + " ", value, " " + after, kind))
    return out


def test_network_finds_forms_that_patterns_miss(spark):
    """Trained on plain forms only, it finds most held-out values spelt in other ways, and little else."""
    rng, rewrite = random.Random(19), np.random.default_rng(4)
    plain = [b + v + a for b, v, a, _ in planted_forms(rng, 400)]
    plain += [f"in {rng.randint(1900, 2030)} we had {rng.randint(1, 10**6)} items at {rng.randint(0, 23)}:{rng.randint(10, 59)} " * 3 for _ in range(60)]
    params = pii.train(docs(spark, plain))
    held, want = [], []
    for b, v, a, kind in planted_forms(rng, 160):
        new = pii.rewritten(kind, v, rewrite)
        held.append(b + new + a)
        want.append((len(b), len(b) + len(new), kind))
    clean = ["a text of the year 2019 with 12 parts and 3.5 of 20 at 10:45", "no digits at all in this one"] * 40
    rows = by_id(pii.find(docs(spark, [*held, *clean]), params))
    missed = [i for i, s in enumerate(want) if s[2] not in {x.kind for x in rows[i].base}]
    right = sum(want[i] in set(map(tuple, rows[i].spans)) for i in missed)
    added = sum(len(r.spans) - len(r.base) for r in rows.values())
    assert len(missed) > 120 and right >= 0.9 * len(missed), (right, len(missed))
    assert right >= 0.9 * added, (right, added)


def test_tagger_gradient():
    tagger = pii.Tagger(hidden=3, embed=2)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 98, (2, 6))
    labels = np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 0, 0]])
    grads, _ = tagger.gradients(codes, labels)
    for name, at in (("U", (1, 2)), ("Wf", (1, 4)), ("Wb", (3, 7)), ("A", (0, 1)), ("E", (int(codes[0, 2]), 1))):
        values = []
        for step in (1e-2, -1e-2):
            tagger.p[name][at] += step
            values.append(tagger.gradients(codes, labels)[1])
            tagger.p[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-2 - float(grads[name][at])) < 2e-3, name


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "add", '{"y": 2.0, "x": 1}', ["b"]), (1, 2, "b", "add", '{"x": "1"}', []), (1, 3, "c", "add", "[1", ["a", "gone"]),
        (2, 1, "a", "add", '{"x": 1, "y": 2, "z": {"q": 1, "a": []}}', ["b"]), (2, 2, "b", "none", None, ["a"]),
        (3, 1, "a", "add", '{"x": 1, "y": 2}', []), (3, 2, "b", "add", '{"x": 1, "y": 2}', ["a"]), (3, 3, "b", "add", '{"x": 1, "y": 2}', []),
        (4, 1, None, "add", '{"x": 1, "y": 2}', None),
    ], "conv bigint, pos bigint, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 5, "a", "3é\n"), (1, 4, "a", "first"), (4, 2, None, "lost")], "conv bigint, pos bigint, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", True)], "name string, field string, type string, required boolean")
    rows = {(r.conv, r.pos): r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert rows[1, 1].canonical == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"first"}'
    assert rows[1, 1].n_results == 2 and rows[1, 1].errors == []
    assert [rows[1, i].level for i in (1, 2, 3)] == [1, 0, 2]
    assert rows[1, 2].errors == ["missing y", "type of x"]
    assert rows[1, 3].errors == ["unknown predecessor", "bad arguments", "missing x", "missing y"]
    assert rows[2, 1].errors == ["cycle", "unknown z"] and rows[2, 2].errors == ["cycle", "bad arguments", "unknown tool"]
    assert rows[3, 2].errors == ["duplicate id"] and rows[3, 2].level == 0
    assert rows[4, 1].canonical == '{"arguments":{"x":1,"y":2},"id":null,"name":"add"}' and rows[4, 1].n_results == 0


def test_odd_arguments(spark):
    deep = "[" * 200_000 + "]" * 200_000
    texts = ['{"x":"\\ud800"}', f'{{"x":{deep}}}', '{"x":NaN}', '{"x":1e999}', '{"x":-Infinity}', '{"\\udc01":1,"x":"\\ud83d\\ude00"}', '{"x":' + '[' * 300 + ']' * 300 + '}', '{"x":"' + "y" * 300_000 + '"}']
    calls = spark.createDataFrame([(1, i, f"c{i}", "t", a, None) for i, a in enumerate(texts)], "conv bigint, pos bigint, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv bigint, pos bigint, call_id string, content string")
    schemas = spark.createDataFrame([("t", "x", "string", True)], "name string, field string, type string, required boolean")
    rows = {r.pos: r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert rows[0].canonical == '{"arguments":{"x":"\\ud800"},"id":"c0","name":"t"}' and rows[0].errors == []
    for i in (1, 2, 3, 4):
        assert rows[i].errors == ["bad arguments", "missing x"] and '"arguments":{}' in rows[i].canonical, i
    assert rows[5].errors == ["unknown \\udc01"] and rows[5].canonical.startswith('{"arguments":{"x":"😀","\\udc01":1}')
    assert rows[6].errors == ["type of x"] and rows[7].errors == [] and len(rows[7].canonical) > 300_000


def test_chain_levels_do_not_depend_on_positions(spark):
    rng = random.Random(12)
    graphs = {
        1: {f"n{i}": [f"n{i - 1}"] * (i > 0) for i in range(21)},
        2: {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "gone"], "e": []},
        3: {"a": ["b"], "b": ["a"], "c": ["b"], "d": [], "e": ["d"]},
    }
    rows, conv_of = [], {}
    for number, graph in graphs.items():
        for shuffled in (False, True):
            conv, order = 10 * number + shuffled, list(graph)
            if shuffled:
                rng.shuffle(order)
            conv_of[conv] = graph
            rows += [(conv, i, n, "t", "{}", graph[n]) for i, n in enumerate(order)]
    calls = spark.createDataFrame(rows, "conv bigint, pos bigint, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv bigint, pos bigint, call_id string, content string")
    schemas = spark.createDataFrame([], "name string, field string, type string, required boolean")
    found = {(r.conv, r.call_id): r for r in toolcalls.link_calls(calls, results, schemas).collect()}

    def level(graph, name, seen=()):
        if name in seen:
            return None
        own = [level(graph, b, (*seen, name)) for b in graph[name] if b in graph]
        return None if None in own else max(own, default=-1) + 1

    assert len(found) == len(rows)
    for (conv, name), r in found.items():
        want = level(conv_of[conv], name)
        assert r.chain_level == want and ("cycle" in r.errors) == (want is None), (conv, name)


def test_empty_tables(spark):
    none = docs(spark, ["x"]).filter("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for frame in (
        linededup.drop_repeated_lines(none), minmax.near_duplicates(none), decontam.find_benchmark(none, bench),
        repeats.remove_repeats(none), bpe.decode(bpe.encode(none, RANKS), RANKS), pii.find(none, pii.train(none)),
        langid.identify(none, langid.train(none)), toxicity.score(none, toxicity.fit(none, labels, none.doc_id >= 0)),
        rules.quality(none, labels, F.col("doc_id") >= 0, F.col("doc_id") < 0),
    ):
        assert frame.collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a line that is long enough to count"), (None, "a line that is long enough to count"), (5, "a line that is long enough to count"), (5, "other")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert linededup.drop_repeated_lines(frame).count() == 4
    assert minmax.near_duplicates(frame).count() == 4
    assert repeats.remove_repeats(frame).count() == 4
    assert bpe.encode(frame, RANKS).count() == 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    texts = random_texts(rng, 30, 500, 80) + ["", None, "123 456"]
    docs(spark, texts, ["en", "de"] * 21 + ["en"]).selectExpr("*", "bigint(length(text)) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[0].split()[:15]) or "none")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        frame = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < frame.count() < len(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def brute_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    return {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()


def brute_near(texts):
    """For each text the number of the first text of its near-duplicate group."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and root[i] != root[j]:
                top, keep = max(root[i], root[j]), min(root[i], root[j])
                root = [keep if r == top else r for r in root]
    return root


def digest(b):
    return hashlib.sha256(b).hexdigest()


def brute_tokens(rows):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    ids = [own.encode_ordinary(t or "") for _, t in rows]
    return Counter((i, len(x), digest(" ".join(map(str, x)).encode()), digest((t or "").encode())) for (i, t), x in zip(rows, ids))


SHARED = "A line that some of the documents share"


def test_pipeline_rows_match_brute_force(spark, tmp_path):
    """Stages two to five by hand; which rows the language stage lets through is its own decision."""
    import corpus_pipeline

    rng = random.Random(13)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    texts += [t.rsplit(" ", 2)[0] + " edit" for t in texts[:6]]
    texts = [f"{t}\n{SHARED}" if i % 5 == 0 else t for i, t in enumerate(texts)] + ["", None, "123 456"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[0]), (7, texts[7]), (9, texts[31])]
    frame = spark.createDataFrame([(i, t, "en", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(texts[12].split()[5:20])), (2, "none")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(r.doc_id, r.text) for r in corpus_pipeline.language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()]
    assert len(left) > 30
    key = lambda x: low(x).strip(" \t\n\x0b\x0c\r")
    holders = {}
    for i, t in left:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    keeps = lambda i, x: len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i
    left = sorted((i, "\n".join(x for x in t.split("\n") if keeps(i, x))) for i, t in left)
    left = [row for n, (row, root) in enumerate(zip(left, brute_near([t for _, t in left]))) if n == root]
    bench = set().union(*(brute_windows(t) for _, t in items))
    sizes = {len(x) for x in bench}

    def leaks(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return any(tuple(w[k : k + n]) in bench for n in sizes for k in range(len(w) - n + 1))

    left = [row for row in left if not leaks(row[1])]
    assert [i for i, _ in left].count(0) == 1 and 12 not in [i for i, _ in left]
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == brute_tokens(left)


def test_digests_of_registered_queries(spark, tmp_path):
    rng = random.Random(14)
    piece = "".join(rng.choices("abcdefgh ", k=260))
    texts = [t for t in ODD if t is None or "\x1c" not in t] + random_texts(rng, 12) + [f"x{piece}y", f"{piece}z"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    items = [None, "", "Tie", *(" ".join((t or "").split()[2:19]) for t in texts[8:14])]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = str(tmp_path)
    assert Counter(map(tuple, queries.op10_bpe(spark, at).collect())) == brute_tokens(list(enumerate(texts)))
    root = brute_near(texts)
    assert [(r.component_id, r.kept) for r in sorted(queries.op7_minmax(spark, at).collect())] == [(root[i], root[i] == i) for i in range(len(texts))]
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    found = by_id(queries.op6_repeats(spark, at))
    for i, t in enumerate(raw):
        gone = {x for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for x in range(k, k + 200)}
        assert (found[i].n_removed, found[i].kept_sha256) == (len(gone), digest(bytes(b for k, b in enumerate(t) if k not in gone)))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet/*.parquet')")
    windows = [(str(i), brute_windows(t)) for i, t in enumerate(items)]
    want = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        spans = [(x, k, len(win)) for x, own in windows for win in own for k in range(len(w) - len(win) + 1) if tuple(w[k : k + len(win)]) == win]
        who = sorted({x for x, _, _ in spans})
        want[i] = (i, len(w), len({p for _, k, n in spans for p in range(k, k + n)}), len(who), digest(",".join(who).encode()), bool(who))
    assert {r.doc_id: tuple(r) for r in queries.op9_decontaminate(spark, at).collect()} == want
    assert {r[0]: r for r in con.execute(queries.oracle_sql()["op9_decontaminate"]).fetchall()} == want


def test_bpe_tasks_return_their_memory(monkeypatch):
    """Workers live on between stages; what they keep counts against the executor."""
    from types import SimpleNamespace

    done = []
    monkeypatch.setattr(bpe, "free_memory", lambda: done.append(common.free_memory()))
    assert list(bpe._encode_parts(SimpleNamespace(value={}))(iter([]))) == [] and len(done) == 1

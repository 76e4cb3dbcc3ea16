"""Phrase collocations, spelling variants and packing against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from netloom.llm import packing, phrases, queries, spelling
from tests.llm.test_operators import ODD, docs, low, random_texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|> hi  \n\n x<|endoftext|>"


# Phrases


def brute_phrases(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * t >= 50 * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, t in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_texts(rng):
    words = ["Ab", "bÉ", "c", "d-d", "e", "\x1cf", "漢", "g\x85h", "i'", "0"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " . ", ", ", "\n", "!"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += ["new york city, " * 12, "new york state. " * 7, "tie tie tie tie " * 6, *ODD, *ODD]
    return texts, [rng.choice(["en", "de", None]) for _ in texts]


@pytest.mark.parametrize("max_bits,least", [(1 << 28, 10), (1 << 15, 3)])
def test_phrases(spark, max_bits, least):
    texts, langs = phrase_texts(random.Random(20))
    frame = docs(spark, texts, langs)
    found = phrases.collocations(frame, least=least, max_bits=max_bits)
    want = brute_phrases(list(zip(texts, langs)), least)
    assert len(want) > 20 and any(len(w[2].split(" ")) == 3 for w in want)
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, phrases.collocations(frame, least=least, top=2).collect())) == [w for w in want if w[1] <= 2]


def test_phrase_bitmap_lets_frequent_parts_through(spark):
    """Also where every bit of a small bitmap is shared by several words."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words[i : i + 3000]) for i in range(0, 30_000, 3000)] * 3
    rng.shuffle(texts)
    found = phrases.collocations(docs(spark, texts), least=3, max_bits=1 << 15, top=10**6)
    assert found.count() == 30_000 - 10 * 2  # triples, as each pair lies within one


def test_keys_of_ngrams_are_counted_over_slices_and_without_distinct_words(monkeypatch):
    def no(*_):
        raise AssertionError("distinct words of a slice were asked for")

    monkeypatch.setattr(phrases, "distinct_spans", no)
    monkeypatch.setattr(phrases, "POOL", 12)
    monkeypatch.setattr(phrases, "_ROWS", 2)
    everything = SimpleNamespace(value=[np.full(4096, 255, np.uint8)] * 2)
    batch = pa.record_batch([pa.array(["a", "a", "b"]), pa.array(["X y z, x y", "x Y z", "x y z"])], names=["lang", "body"])
    for size, want in ((2, [1, 1, 2, 3]), (3, [1, 2])):
        made = list(phrases._key_counts(size, everything)(iter([batch.slice(0, 1), batch.slice(1, 2), batch.slice(0, 0)])))
        assert sorted(c for b in made for c in b.column("c").to_pylist()) == want and max(b.num_rows for b in made) <= 2
    assert not list(phrases._key_counts(2, everything)(iter([])))


def test_phrases_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 256)
    texts, langs = phrase_texts(random.Random(22))
    rows = [(" ".join(t for t in texts if t), "en"), ("word " * 500, "de")]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"lang": [l for _, l in rows], "body": [t for t, _ in rows]})
    got = Counter()
    for part, langs in phrases._parts(batch):
        w = phrases.Words(part, langs)
        for at in np.flatnonzero(w.follows[0]):
            got[langs[0], w.word[w.number[at]].as_py(), w.word[w.number[at + 1]].as_py()] += 1
    want = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, *p) for p in zip(w, w[1:]))
    assert got == want


def test_scores_are_exact(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(500):
        l, r = (rng.randint(1, 10 ** rng.randint(1, 15) - 1) for _ in range(2))
        rows.append((rng.randint(1, min(l, r)), l, r))
    rows += [(10**15 - 1, 10**15 - 1, 10**15 - 1), (1, 10**15 - 1, 10**15 - 1), (999, 1000, 998001)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", phrases.score_of("a", "l", "r")).collect()
    assert [x.s for x in got] == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_phrase_query_and_sql(spark, tmp_path):
    texts, langs = phrase_texts(random.Random(24))
    docs(spark, texts, langs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_phrases(spark, str(tmp_path)).collect()))
    assert got == brute_phrases(list(zip(texts, langs)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(queries.oracle_sql()["op11_phrases"]).fetchall()) == got


# Spelling


def edits(w, alphabet):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in alphabet} | {a + c + b for a, b in cut for c in alphabet}) - {w}


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    alphabet = {c for w in n for c in w}
    near = {w: [x for x in edits(w, alphabet) if x in n] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def variant_texts(rng):
    base = ["".join(rng.choices("abéÿ", k=rng.randint(6, 11))) for _ in range(25)]
    some = [*base, *(rng.choice(sorted(edits(rng.choice(base), "abÉÿz"))) for _ in range(150)), "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "Xy" * 40, "Xy" * 40 + "x"]
    texts = []
    for _ in range(80):
        texts.append(rng.choice([" ", "-", "1", "×"]).join(rng.choices(some, k=rng.randint(0, 60))))
    texts += ["Government " * 300, "government goverment " * 3, "govermen " * 2, "goverment " * 25, *ODD]
    return texts


@pytest.mark.parametrize("block,tile", [(4096, 256), (6, 4)])
def test_spelling_variants(spark, block, tile, monkeypatch):
    texts = variant_texts(random.Random(30))
    plain = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: plain(words, block, tile))
    got = sorted(map(tuple, spelling.variants(docs(spark, texts)).collect()), key=lambda r: r[0])
    want = brute_variants(list(enumerate(texts)))
    assert got == sorted(want, key=lambda r: r[0])
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] > 1 for r in want) > 10


def test_spelling_query_null_ids_and_repeated_rows(spark, tmp_path):
    texts = variant_texts(random.Random(31))
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_spelling(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == brute_variants(rows)


def test_pairs_of_a_tile():
    rng = random.Random(32)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(7, 8))) for _ in range(200)})
    kind = [np.zeros(len(words), t) for t in (np.int64, bool, np.int64, np.int64)]
    tile = spelling.Tile(words, kind[0] + 7, kind[1], kind[2] - 1, kind[3])
    i, j = spelling.near_pairs(tile, tile, True)
    want = {frozenset((a, b)) for a in words for b in edits(a, "ab") if b in words and min(len(a), len(b)) == 7}
    assert {frozenset((words[a], words[b])) for a, b in zip(i, j)} == want and len(i) == len(want)


# Packing


def places(matches):
    found, ranks = defaultdict(list), Counter()
    for length, lo, hi, sequence, each, used in matches:
        for r in range(lo, hi):
            found[sequence + (r - lo) // each].append((used + (r - lo) % each * length, length))
            ranks[length, r] += 1
    return found, ranks


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
    return len(gaps)


def test_sweeps_pack_every_piece_once():
    rng = random.Random(40)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 30, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        found, ranks = places(packing.pack_counts(counts, capacity))
        assert ranks == Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})
        assert sorted(found) == list(range(len(found)))
        for own in found.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert least <= len(found) <= max(best_fit_decreasing(counts, capacity) + 1, 1.03 * best_fit_decreasing(counts, capacity))


def test_packing_counts_of_any_size():
    rng = random.Random(41)
    counts = {n: rng.randint(0, 10**9) for n in range(1, 1025)}
    found = packing.pack_counts(counts, 1024)
    assert len(found) < 20_000
    total = max(s + (hi - lo) // each for _, lo, hi, s, each, _ in found)
    assert total < 1.01 * sum(n * c for n, c in counts.items()) / 1024


def check_packing(rows, got, capacity, end_id=2):
    tok = Tokenizer.from_file(TOKENIZER)
    want, tokens = Counter(), 0
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        tokens += len(ids)
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-tokens // capacity)


@pytest.mark.parametrize("capacity", [1024, 16, 1])
def test_packing(spark, capacity):
    texts = [*ODD, *random_texts(random.Random(42), 40), SPECIAL, "word " * 3000, SPECIAL, "xy" * 900]
    got = packing.pack(docs(spark, texts), TOKENIZER, capacity=capacity, block_rows=10).collect()
    used, least = check_packing(list(enumerate(texts)), got, capacity)
    assert used <= 1.05 * least + 1


def test_packing_query_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (5, None), (6, "x " * 2000)] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(rows, queries.op13_packing(spark, str(tmp_path)).collect(), 1024)


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    from netloom.llm import bpe

    monkeypatch.setattr(bpe, "BATCH_BYTES", 40)
    monkeypatch.setattr(bpe, "text_pieces", lambda t, b: __import__("netloom.llm.common", fromlist=["x"]).text_pieces(t, b, 40))
    text = " ".join(random_texts(random.Random(43), 20)) + "  two  blanks\n\n here's " + "z" * 200
    tok = packing.Tokens(TOKENIZER, max_known=50)
    direct = tok.tokenizer.encode(text, add_special_tokens=False).ids
    found = tok.ids([text, "", "short", text])
    assert [list(f) for f in found] == [direct, [], tok.tokenizer.encode("short").ids, direct]


def test_empty_tables(spark):
    none = docs(spark, ["x"]).filter("doc_id < 0")
    for frame in (phrases.collocations(none), spelling.variants(none), packing.pack(none, TOKENIZER)):
        assert frame.collect() == []

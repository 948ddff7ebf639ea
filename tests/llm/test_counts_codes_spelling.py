"""Token counts, vector codes and spelling groups against the library and plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import spelling, token_counts, vector_codes
from quillgraph.llm.queries import QUERIES, vocabulary_file
from tests.llm.test_pure import odd_texts

FILE = vocabulary_file("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_equal_the_library():
    rng, t, own = random.Random(4), library(), token_counts.TokenCounter(FILE, kept=50)
    cases = ["", " ", "\n\n  x", "It's 12,345 don't", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "ab" * 4000, "=" * 3001, " " * 999 + "x", "日本語" * 300, "‍️😀" * 9, "a\x1cb\x85c　d", "0" * 77, "\r\n\r\n \t"]
    cases += ["".join(rng.choice("aeiouthrnsld'., 1=\n") for _ in range(rng.randint(1, 80))) for _ in range(1500)] + odd_texts(seed=5)
    want = [len(t.encode(text, add_special_tokens=False).ids) for text in cases]
    for text, n in zip(cases, want):
        assert own.count(text) == n, ascii(text)
    spaced = ["".join(rng.choice(["a", "b1", "'s", " ", " ", "\n", "\xa0", "\u2003", "!", "<|endoftext|>", "\x00", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for part in (cases, spaced[:1000], spaced[1000:], [x.replace("\x00", "") for x in spaced], [""], []):
        told = own.count_all(pa.array(part, pa.large_string())) if part else []
        assert list(told) == [len(t.encode(x, add_special_tokens=False).ids) for x in part]
    assert len(own.segments) < 5000


def test_classes_of_all_letters_equal_the_library():
    t, own = library(), token_counts.TokenCounter(FILE)
    points = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FC00)]
    for begin in range(0, len(points), 64):
        # each between a letter, a number, a mark and spaces
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}a" for c in points[begin : begin + 64])
        if own.count(text) != len(t.encode(text, add_special_tokens=False).ids):
            assert [hex(c) for c in points[begin : begin + 64] if own.count(s := f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}a") != len(t.encode(s, add_special_tokens=False).ids)] == []


def test_walked_texts_count_the_same(monkeypatch):
    own, text = token_counts.TokenCounter(FILE), "Some words, 12 of <|endoftext|> them.\n\n " * 50
    want = own.count(text)
    assert own.count_all(pa.array([text], pa.large_string())).tolist() == [want]
    monkeypatch.setattr(token_counts, "WALKED", 10)
    assert own.count(text) == want and own.count_all(pa.array([text], pa.large_string())).tolist() == [want]


def test_op13_rows(spark, tmp_path):
    rows = [(1, "a b", "x"), (2, None, "x"), (2, None, "x"), (3, "", "x"), (None, "word " * 3000, "x"), (5, "é<|endoftext|>", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_token_counts"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    t = library()
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and any(w[3] for w in want)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(codes, errors, codebooks) of (vec_id, whole numbers), all sums made anew each round."""
    q = np.array([r[1] for r in rows], np.int64)
    own = q.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], struct.pack(f"<{q.shape[1]}i", *q[i])))[:entries]
    books = [[q[i, p * own : (p + 1) * own].tolist() for i in order] for p in range(parts)]
    for k in range(rounds + 1):
        code, error = np.zeros((len(q), parts), int), np.zeros(len(q), np.int64)
        for p in range(parts):
            for i, x in enumerate(q[:, p * own : (p + 1) * own].tolist()):
                off = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
                code[i, p] = off.index(min(off))
                error[i] += min(off)
        if k == rounds:
            return code, error, books
        for p in range(parts):
            for e in range(len(books[p])):
                mine = q[code[:, p] == e, p * own : (p + 1) * own].tolist()
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("scale,entries", [(1.0, 8), (2e4, 6), (1.0, 400)])
def test_codes_equal_plain_rounds(spark, scale, entries):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 8)) * scale
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 5] + rng.normal(size=8) * scale * 0.3], int(i % 3)) for i in range(90)]
    rows += [(200, rows[0][1], None), (3, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    entries_ = min(entries, 256)
    got, books = vector_codes.compress_vectors(df, entries=entries_)
    q = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v, _ in rows]
    code, error, want = plain_codes(q, entries=entries_)
    assert books.tolist() == want and digest(want) == vector_codes.codebooks_digest(books)
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error) for r in got.collect()) == sorted((i, bytes(code[k].tolist()).hex(), int(error[k])) for k, (i, _) in enumerate(q))


def test_nearest_in_whole_numbers():
    rng = np.random.default_rng(8)
    for most in (3, 1 << 20, (1 << 27) - 1):
        x, b = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (20, 16))
        b[7] = b[3]
        at, off = vector_codes.nearest(x, b)
        for i in range(len(x)):
            all_ = [sum((int(p) - int(q)) ** 2 for p, q in zip(x[i], e)) for e in b]
            assert at[i] == all_.index(min(all_)) and off[i] == min(all_)


def test_op12_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=64)], None if i % 4 == 0 else i % 4) for i in range(40)]
    odd = [(100, None, 1), (101, [0.1] * 63 + [None], 1), (102, [float("nan")] * 64, 1), (103, [float("inf")] * 64, 1), (104, [1e30] * 64, 2), (105, [], None), (106, [0.5] * 3, None), (None, good[0][1], 7)]
    spark.createDataFrame([(*r, "x", "y") for r in good + odd], "vec_id bigint, embedding array<float>, label int, code string, q string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    assert {r.vec_id for r in got} == {*range(40), 104, 105, 106, None} and len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 8 for r in got)
    label = {i: x for i, _, x in good + odd}
    for r in got:
        assert r.label_error == sum(o.error for o in got if label[o.vec_id] == label[r.vec_id])
    assert next(r for r in got if r.vec_id is None).code == next(r for r in got if r.vec_id == 0).code


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(docs):
    n = Counter()
    for i, text in docs:
        run, runs = "", []
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                runs.append(run)
                run = ""
        for w in runs:
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        by = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = by[0] if by and n[by[0]] >= 2 * n[w] else None
        out[w] = [form, n[w], len(by), n[form] if form else None]
    rows = []
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, *rest))
    return sorted(rows)


def spelled_docs(n_docs=160, seed=6):
    rng = random.Random(seed)
    letters = "aabcdeéÿ×"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "ababa"]

    def one():
        w = rng.choice(roots[: rng.choice([3, 10, 65])])
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    docs = [(i, rng.choice([" ", ", ", "1", "Ā"]).join(one() for _ in range(rng.randint(0, 60)))) for i in range(n_docs)]
    return docs + [(7, docs[7][1]), (None, "aaaab aaaab aaaab aaaab"), (900, None), (901, ""), (902, "12 .. ß")]


def test_op11_rows(spark, tmp_path):
    docs = spelled_docs()
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()))
    want = plain_groups(docs)
    assert got == want and len(want) > 200 and any(r[1] and r[2] != r[1] for r in want)


def test_automata_find_all_one_error_words_in_any_blocks(spark):
    want = {w: (k, near_n) for w, _, _, k, near_n, _ in plain_groups(spelled_docs(seed=9))}
    words = spark.createDataFrame([(w, n) for w, (n, _) in want.items()], "word string, n bigint")
    for block in (7, 60, 100_000):
        got = {r.word: r.n_near for r in spelling.near_words(words, block).collect()}
        assert got == {w: k for w, (_, k) in want.items()}, block


def test_automaton_numbers_words_and_stays_small():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    a = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = a.walk(a.root, 0, w)
        assert a.final[state] and number == k
    for w in [*words[::7], "abababab", "x", ""]:
        for exact in range(len(w) + 1):
            assert {words[k] for k in a.near(w, exact)} == {v for v in words if v[:exact] == w[:exact] and near(v, w)}, (w, exact)
    full = spelling.Automaton(sorted("".join(chr(97 + (i >> k & 1)) for k in range(10)) for i in range(1024)))
    assert len(full.edges) == 11 and full.count[full.root] == 1024


def test_words_with_one_prefix_ask_few_blocks():
    rng = random.Random(2)
    words = sorted({"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    forward = [words[i] for i in range(100, len(words), 100)]
    backward = sorted(w[::-1] for w in words)[100::100]
    asked = [spelling.asked_blocks(w, w[::-1], forward, backward) for w in words]
    assert np.mean([len(f) + len(b) for _, f, b in asked]) < 6


def test_pa_strings_are_lowered_in_ascii_alone(spark):
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame([(1, "ÀBCDE àbcde ÀBCDE ÀBCDE")], "doc_id bigint, text string"), fewest=1).collect()}
    assert got == {"Àbcde": 3, "àbcde": 1} and pa.array([1])[0].as_py() == 1

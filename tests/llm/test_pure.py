"""Operators' inner parts against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import bpe, embed_dedup, media, packing, sharding, toxicity, words
from quillgraph.llm.embed_dedup import bucket_codes, bucket_keys, hadamard, hit_rate
from quillgraph.llm.embed_dedup import plan as vector_plan
from quillgraph.llm.near_dedup import plan, shingle_sets, signatures
from quillgraph.llm.queries import vocabulary_file


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file())
    t.no_truncation()
    t.no_padding()
    return t


#: Letters that compose, fold or split in ways of their own, white space of all kinds, marks, special tokens and code points of late Unicode versions.
ODD = ["a", "J\u030c", "H\u0331x", "I\u0307", "A\u030a", "Σ", "ς", "İ", "ß", "é", "e\u0301", "\u212a", "\u1c89", "\ua7cb", "日本", "слово", "😀", "\xa0", "\u2003", "\x85", "\x1c", "\x1f", "\u200b", "'s", "''s", "it's", "3.5", "½", "…", "—,", "$$$", ".%%%", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", " ", "  ", "\n", "\t", "\u0338=", "=\u0338", "_", "\x00", "Ⅷ", "ǅ", "ﬁ", "\u0345"]


def odd_texts(n=3000, seed=11):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_bpe_equals_the_library():
    rng, vocab, t = random.Random(1), bpe.Vocabulary(vocabulary_file()), library()
    cases = ["", " \n", "Don't STOP it's 12 <|endoftext|>x", "ÀÉ Σας ΟΔΟΣ ß İ é \xa0 日本 😀 \x1c a\x1db", "</w> a</w>", "!" * 300, "a" * 5000, "<|", "ab<|startoftext|><|endoftext|>"]
    cases += ["".join(rng.choice("aeiouthrnsld'.,") for _ in range(rng.randint(1, 60))) for _ in range(500)] + odd_texts()
    tokens = pa.array(bpe.token_list(vocabulary_file()), pa.large_string())
    encoded = vocab.encode(pa.array(cases))
    for text, ids, decoded in zip(cases, encoded.to_pylist(), bpe.decode(encoded, tokens).to_pylist()):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, ascii(text)
        assert decoded == t.decode(want, skip_special_tokens=False)
    assert vocab.encode(pa.array([None, "a"])).to_pylist()[0] == b"" and vocab.encode(pa.array([], pa.string())).to_pylist() == []
    assert bpe.decode(pa.array([None, b""], pa.binary()), tokens).to_pylist() == [None, ""]


def test_packing_words_equal_the_library():
    t, words = library(), packing._words(vocabulary_file())
    cases = odd_texts(seed=12)
    ids, ends = words.encode(pa.array(cases))
    for text, begin, end in zip(cases, [0, *ends], ends):
        assert ids[begin:end].tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_are_forgotten_without_a_trace():
    vocab = bpe.Vocabulary(vocabulary_file())
    vocab.texts.kept = 3
    texts = [f"word{i} other, Thing{i % 4}. É{i}" for i in range(30)]
    assert [vocab.encode(pa.array([t]))[0].as_py() for t in texts] == bpe.Vocabulary(vocabulary_file()).encode(pa.array(texts)).to_pylist()
    assert len(vocab.texts.table.row) < 20


def test_long_texts_go_in_parts():
    rng = random.Random(13)
    texts = pa.array(["é b", None, " ".join(rng.choice(["alpha", "beta,", "gammaé", "x" * 70]) for _ in range(400)), "", "y" * 300 + " z", "end"])
    vocab = bpe.Vocabulary(vocabulary_file())
    want = vocab.encode(texts)
    cuts = list(words.parts(texts, 50))
    assert sum(going for _, going in cuts) > 100 and "".join(t.as_py() for c, _ in cuts for t in c) == "".join(t or "" for t in texts.to_pylist())
    whole, size = words.parts, words.PART
    try:
        bpe.parts = lambda t: whole(t, 50)
        assert vocab.encode(texts) == want
    finally:
        bpe.parts = whole
    assert size == words.PART
    many = pa.array([None if rng.random() < 0.1 else "é B%d, " % i * rng.randint(0, 20) for i in range(60)])
    for _ in range(100):
        begin, n = rng.randint(0, 40), rng.randint(0, 20)
        own = [t for c, _ in words.parts(many.slice(begin, n), rng.choice([20, 90, 5000])) for t in words.pc.ascii_lower(c).to_pylist()]
        assert "".join(own) == "".join((t or "").lower() for t in many.slice(begin, n).to_pylist())


def test_pieces_of_rows_that_go_on():
    rng = random.Random(14)
    for _ in range(200):
        counts, going, capacity = np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 5))]), rng.random() < 0.5, rng.randint(1, 9)
        row, place, length, left = packing.cut(counts, going, capacity)
        got = [(r, p, n) for r, p, n in zip(row.tolist(), place.tolist(), length.tolist())]
        want = []
        for r, n in enumerate(counts.tolist()):
            n -= n % capacity if going and r == len(counts) - 1 else 0
            want += [(r, p, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))]
        assert got == want and left == (counts[-1] % capacity if going else 0)


def test_best_fit_bins():
    rng = random.Random(2)
    for open_bins in (1, 4, 10_000):
        fit, used = packing.BestFit(100, open_bins), {}
        for _ in range(2000):
            n = rng.randint(1, 100)
            b, at = fit.place(n)
            assert used.get(b, 0) == at and at + n <= 100
            used[b] = at + n
            assert fit.open <= open_bins
    best = packing.BestFit(10, 5)
    assert [best.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    closing = packing.BestFit(10, 1)
    assert [closing.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]


def test_best_fit_equals_a_plain_one_with_closings():
    rng, closings = random.Random(15), 0
    for capacity, most in ((50, 3), (64, 8), (20, 1), (100, 40)):
        fit, bins, made = packing.BestFit(capacity, most), [], 0
        for n in sorted((rng.randint(1, capacity) for _ in range(600)), reverse=rng.random() < 0.5):
            good = [b for b in bins if b[1] >= n]
            if good:
                free = min(b[1] for b in good)
                own = [b for b in good if b[1] == free]
            else:
                if len(bins) >= most:
                    free = min(b[1] for b in bins)
                    # of bins with equal space the one that got it last
                    bins.remove([b for b in bins if b[1] == free][-1])
                    closings += 1
                own = [[made, capacity]]
                bins += own
                made += 1
            chosen = own[-1]
            assert fit.place(n) == (chosen[0], capacity - chosen[1])
            bins.remove(chosen)
            if chosen[1] > n:
                bins.append([chosen[0], chosen[1] - n])
    assert closings > 100


def test_differencing_balances():
    rng = random.Random(3)
    weights = [rng.randint(1, 1000) for _ in range(500)]
    slots, sums = sharding.difference([[w] for w in weights], 7)
    got = [0] * 7
    for w, (s,) in zip(weights, slots):
        got[s] += w
    assert sorted(got) == sorted(sums) and max(got) - min(got) <= 5
    parts = [[1, 2, 3], [9, 1, 1], [4, 4, 4]]
    slots, sums = sharding.difference(parts, 3)
    assert all(sorted(s) == [0, 1, 2] for s in slots) and sum(sums) == 29
    assert sharding.difference([], 3) == ([], [0, 0, 0])


def scalar_decode(data):
    """A plain decoder, bit by bit: the DC values of the first component in scan order."""
    f = media.parse(data)[0]
    codes = {k: {(n, c): s for s, c, n in media._codes(list(t[:16]), t[16:])} for k, t in f.tables.items()}
    scan, segs, i = data[f.begin : f.end], [bytearray()], 0
    while i < len(scan):
        if scan[i] == 255 and scan[i + 1] != 0:
            segs.append(bytearray())
            i += 2
            continue
        segs[-1].append(scan[i])
        i += 2 if scan[i] == 255 else 1
    across, down = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if len(f.parts) == 1:
        across = down = 1
    left, out = -(-f.width // (8 * across)) * -(-f.height // (8 * down)), []
    for seg in segs:
        bits, at = "".join(f"{b:08b}" for b in seg), 0
        last = [0] * len(f.parts)

        def symbol(table):
            nonlocal at
            n, code = 0, 0
            while (n, code) not in codes[table]:
                code, n, at = code * 2 + int(bits[at]), n + 1, at + 1
            return codes[table][n, code]

        for _ in range(min(f.restart or left, left)):
            left -= 1
            for place, dc, ac in f.chosen:
                for _ in range(1 if len(f.parts) == 1 else f.parts[place][1] * f.parts[place][2]):
                    n = symbol(dc)
                    v = int(bits[at : at + n] or "0", 2)
                    at += n
                    last[place] += v if n == 0 or v >> (n - 1) else v - (1 << n) + 1
                    if place == 0:
                        out.append(last[0])
                    k = 1
                    while k < 64:
                        rs = symbol(0x10 | ac)
                        at += rs & 15
                        k = 64 if rs & 15 == 0 and rs >> 4 < 15 else k + (rs >> 4) + 1
    return out


def colour_image(rng):
    """A 4:2:0 image with AC coefficients and no restarts, its codes of eight bits each."""
    dc, ac = bytes(range(12)), bytes([0x00, 0xF0, 0x01, 0x11, 0x53, 0x02])
    table = lambda s: bytes([0] * 7 + [len(s)] + [0] * 8) + s
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, b"\x08\x00\x20\x00\x30\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += media._segment(0xC4, b"\x00" + table(dc) + b"\x10" + table(ac)) + media._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    bits = ""
    for _ in range(3 * 2):
        for _ in range(6):
            n = rng.randint(0, 5)
            bits += f"{n:08b}" + (f"{rng.getrandbits(n):0{n}b}" if n else "")
            k = 1
            while k < 50 and rng.random() < 0.7:
                i = rng.choice([1, 2, 3, 4, 5])
                rs = ac[i]
                bits += f"{i:08b}" + (f"{rng.getrandbits(rs & 15):0{rs & 15}b}" if rs & 15 else "")
                k += (rs >> 4) + 1
            bits += f"{0:08b}"
    bits += "1" * (-len(bits) % 8)
    return head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg_round_trip_and_scalar_decoder():
    rng = random.Random(4)
    payloads = [b"", b"a", b"x" * 192, b"y" * 193, bytes(range(256)) * 3, rng.randbytes(4000), rng.randbytes(192 * 8191 + 5)]
    stored = media.encode(payloads)
    for p, frames in zip(payloads, media.decode(stored)):
        got = b"".join(f.thumbnail.ravel()[: int(f.comment.split(b";")[1])].tobytes() for f in frames)
        assert got == p.ljust(max(192, -(-len(p) // 192) * 192), b" ")
    assert media.encode(payloads[:5]) == stored[:5]
    for p, s in zip(payloads[:6], stored):
        assert [v + 128 for v in scalar_decode(s)] == list(p.ljust(max(192, -(-len(p) // 192) * 192), b" "))
    for _ in range(5):
        image = colour_image(rng)
        (frame,) = media.decode([image])[0]
        assert frame.thumbnail.shape == (4, 6)
        grid = np.array(scalar_decode(image)).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
        assert (frame.thumbnail == np.clip(np.rint(grid * 2 + 128), 0, 255)).all()
    with pytest.raises(ValueError):
        media.decode([b"not an image"])


def test_media_in_steps_and_bad_media(monkeypatch):
    rng = random.Random(18)
    payloads = [b"", b"ab" * 3000, rng.randbytes(192 * 40 + 7), bytes([255]) * 5000, b"z"]
    stored = media.encode(payloads)
    monkeypatch.setattr(media, "STEP", 400)
    assert media.encode(payloads) == stored
    assert [media._told(f)[3][: len(p)] for f, p in zip(media.decode(stored), payloads)] == payloads
    for _ in range(400):
        broken = bytearray(rng.choice(stored))
        for _ in range(rng.randint(1, 4)):
            broken[rng.randrange(min(len(broken), 700))] = rng.randrange(256)
        read = media._read([stored[0], bytes(broken[: rng.randint(0, len(broken))]), stored[4]])
        assert media._told(read[0])[2] == 0 and media._told(read[2])[2] == 1 and len(media._told(read[1])) == 6
    assert media._told(media._read([b"\xff\xd8junk"])[0])[:5] == (None,) * 5 and media._told(None) == (None,) * 6


def test_a_long_payload_needs_little_more_than_itself():
    import resource

    payload = bytes(range(256)) * 30_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert media._told(media.decode(media.encode([payload]))[0])[3][: len(payload)] == payload
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 600


def sets_of(texts, width):
    values, ends = shingle_sets(pa.array(texts), width)
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def test_signatures_and_sets():
    a, b, empty, one, none = sets_of(["The quick  brown fox", "the quick brown fox\n", " \t", "one", None], 3)
    assert (a == b).all() and len(a) == 2 and len(empty) == 0 == len(none) and len(one) == 1
    k, m, t = plan(0.85)
    of = lambda x: signatures(x, np.array([len(x)]), k)[0]
    assert (of(a) == of(b)).all()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 850, dtype=np.uint64)
    near = 0
    for _ in range(60):
        x = np.concatenate([base, rng.integers(0, 2**63, 75, dtype=np.uint64)])
        y = np.concatenate([base, rng.integers(0, 2**63, 75, dtype=np.uint64)])
        near += (of(x) != of(y)).sum() <= t
        both = signatures(np.concatenate([x, y]), np.array([len(x), len(x) + len(y)]), k)
        assert (both[0] == of(x)).all() and (both[1] == of(y)).all()
    assert near == 60 and 2 * m > t


def test_shingles_equal_plain_ones():
    rng = random.Random(16)
    texts = ["".join(rng.choice(["a", "B", "b", " ", "\n", "\x0b", "\x1c", "é", "\xa0"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for width in (1, 3, 5):
        sets = sets_of(texts, width)
        words = [t.encode().lower().split() for t in texts]
        plain = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for w in words]
        assert [len(x) for x in sets] == [len(x) for x in plain]
        of = {}
        for x, p in zip(sets, plain):
            assert of.setdefault(x.tobytes(), p) == p


def test_hashing_finds_near_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 50))
    assert np.allclose(np.linalg.norm(hadamard(np.pad(x, ((0, 0), (0, 14)))), axis=1), np.linalg.norm(x, axis=1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * unit).sum(1, keepdims=True) * unit
    y = 0.9 * unit + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    last = None
    for rows in (1_000, 100_000, 10_000_000, 10**9):
        k, tables = vector_plan(rows, 50, 0.9)
        a, b = bucket_codes(x, k, tables), bucket_codes(y, k, tables)
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.99
        assert rows * (2 / 128) ** k <= 64 and (last is None or k >= last)
        last = k
    assert 0.5 < hit_rate(50, 0.9) < 1 and len(np.unique(bucket_keys(a, 50)[0])) == a[0].size


def test_cells_stay_whole():
    rng = random.Random(24)
    for _ in range(300):
        cells = sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 80)))
        cuts = sorted(rng.randint(0, len(cells)) for _ in range(5))
        batches = [pa.RecordBatch.from_arrays([pa.array(cells[a:b], pa.int64())], ["cell"]) for a, b in zip([0, *cuts], [*cuts, len(cells)])]
        embed_dedup.TABLE, kept = rng.randint(1, 40), embed_dedup.TABLE
        try:
            tables = [t.column(0).to_pylist() for t in embed_dedup._whole_cells(iter(batches))]
        finally:
            embed_dedup.TABLE = kept
        assert [c for t in tables for c in t] == cells and all(tables) and all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def some_odds():
    return toxicity.Odds(["idiot", "the", "of"], [np.array([0, 1]), np.array([2, 1])], np.array([1, 0]))


def test_network_gradients():
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = ["idiot", "the", "of", "clown"]
    x, places, grams, size = net.inputs(words, some_odds())
    x = x.astype(np.float64)
    at = np.array([[0, 1, 2, 4], [3, 3, 1, 0]])
    y, share = np.array([1, 0]), np.array([0.7, 0.3])

    def loss():
        s = net.forward(net.project(net.inputs_again(x.copy(), places, grams, size)), at)
        return float((share * (np.logaddexp(0, s) - y * s)).sum())

    g = net.gradients(net.inputs_again(x, places, grams, size), places, grams, size, at, y, share)
    for name in ("uf", "ub", "wf", "wb", "att", "out", "bias", "word", "gram"):
        flat = net.p[name].reshape(-1)
        i = int(np.argmax(np.abs(g[name])))
        keep = flat[i]
        flat[i] = keep + 1e-3
        up = loss()
        flat[i] = keep - 1e-3
        down = loss()
        flat[i] = keep
        assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3, name


def plain_score(net, x, window):
    """One window word by word: update and reset gates, both directions, attention, logistic unit."""
    h, logistic = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    states = [np.zeros(2 * h) for _ in window]
    for side, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
        state = np.zeros(h)
        for t in order:
            if window[t] < len(x):
                a, u = x[window[t]] @ net.p["w" + side], net.p["u" + side]
                z, r = (logistic(a[k * h : (k + 1) * h] + state @ u[:, k * h : (k + 1) * h]) for k in (0, 1))
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + (r * state) @ u[:, 2 * h :])
            states[t][h * (side == "b") :][:h] = state
    told = [np.exp(s @ net.p["att"]) if w < len(x) else 0.0 for s, w in zip(states, window)]
    return sum(a * s for a, s in zip(told, states)) @ net.p["out"] / sum(told) + net.p["bias"][0]


def test_network_equals_a_plain_loop():
    rng, net = np.random.default_rng(19), toxicity.Network(0.3)
    words = [f"w{i}ord" for i in range(30)]
    x = net.inputs(words, some_odds())[0]
    at = rng.integers(0, 30, (50, toxicity.WINDOW))
    for row, n in zip(at, rng.integers(1, toxicity.WINDOW + 1, 50)):
        row[n:] = 30
    assert np.allclose(net.forward(net.project(x), at), [plain_score(net, x, row) for row in at], atol=1e-4)


def test_words_and_grams():
    words, flat, size = toxicity.words_of(pa.array(["The cat, (THE) cat!", None, " ", "É\xa0x."]))
    assert [words[i] for i in flat] == ["the", "cat", "the", "cat", "é", "x"] and size.tolist() == [4, 0, 0, 2]
    names = ["a", "abcde", "xyabcde", "b", "ab"]
    whole, grams, count = toxicity._hashes(names)
    assert count.tolist() == [2, 8, 12, 2, 3] and len(set(whole.tolist())) == 5
    of = [set(g.tolist()) for g in np.split(grams, np.cumsum(count)[:-1])]
    plain = [{("<" + n + ">")[i : i + k] if len(n) + 2 >= k else "<" + n + ">" for k in (3, 5) for i in range(max(1, len(n) + 3 - k))} for n in names]
    # the short word as a whole is a gram of five beside one of three
    assert all(len(a & b) == len({g for g in p & q}) for a, p in zip(of, plain) for b, q in zip(of, plain) if a is not b)
    assert toxicity._hashes([])[2].tolist() == []


def test_toxicity_learns_and_holds_out():
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "the", "er", "ou", "in", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    bad = ["idiot", "scum", "loweib", "loweist", "loweier"]
    make = lambda toxic: " ".join([*(rng.choice(plain) for _ in range(rng.randint(10, 120))), *([rng.choice(bad)] * toxic), *(rng.choice(plain) for _ in range(rng.randint(0, 100)))])
    labels = [i % 4 == 0 for i in range(400)]
    model = toxicity.train(pa.array([make(y) for y in labels]), [int(y) for y in labels])
    held = [i % 3 == 0 for i in range(200)]
    score = model.score(pa.array([make(y) for y in held]))
    assert ((score >= 0.5) == held).mean() > 0.95
    scores = model.score(pa.array([None, "", "word " * 50_000, make(True)]))
    assert scores[0] == scores[1] and scores[3] > 0.5 and ((0 <= scores) & (scores <= 1)).all()
    assert toxicity.train(pa.array(["a"]), [1]).score(pa.array(["x"]))[0] == 1.0 and toxicity.train(pa.array([], pa.string()), []).score(pa.array(["x"]))[0] == 0.0

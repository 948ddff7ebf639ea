"""Each registered query over whole small tables with nulls, empties, repeats and extra columns, against plain versions."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest

from quillgraph.llm.queries import QUERIES, vocabulary_file

TEXTS = [
    "Hello there, hello.", None, "", "É" * 50 + " ok", "long Text, of words. " * 900, "Hello there, hello.", "x", " \n\t", "password=b7db7aa4a5fcc78305 here", "it's 3.5% <|endoftext|> done",
    *(" ".join(random.Random(i).choice(["alpha", "beta", "gamma,", "Delta.", "ε"]) for _ in range(120)) for i in range(20)),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", 1, "score", "node") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1, "score", "node")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, sequence_id string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(10, 30)] + [(11, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64)).astype(np.float32)
    vecs = [[float(x) for x in b + rng.normal(size=64).astype(np.float32) * np.float32(s)] for b in base for s in (0.0, 0.1, 0.2, 0.6)]
    more = [(i, v, 1, "x") for i, v in enumerate([*vecs, vecs[0], None, [0.0] * 64, [None] * 64, [float("nan")] * 64, []])]
    spark.createDataFrame(more, "vec_id bigint, embedding array<float>, label int, cell string").write.parquet(f"{d}/embeddings.parquet")
    urls = ["https://a.example.com/fr/1?utm_x=1&b=2", "http://[2001:DB8::1]:8080/p?ref=1", "https://x.net/es/1", None, "no scheme", "https://foe.org/p", "https://foe.org/p"]
    spark.createDataFrame([(i, u, None if i == 2 else f"<a href='https://x.net/{i}'>y</a>", "h", "s") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, status string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def rows(tables):
    return [(i, t or "") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]


def of(spark, name, d):
    out = QUERIES[name](spark, d)
    return out.collect(), out.columns


def test_op2_digests(spark, tables, rows):
    got, columns = of(spark, "op2_media", tables)
    want = set()
    for i, t in rows:
        raw = t.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want.add((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert len(got) == len(rows) and {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (0, 5)}) == 1 and columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file())
    t.no_truncation()
    t.no_padding()
    return t


def test_op3_pieces(spark, tables, rows):
    got, _ = of(spark, "op3_packing", tables)
    t, want = library(), []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(seqs) == -(-sum(r.length for r in got) // 2048)


def test_op10_digests(spark, tables, rows):
    got, _ = of(spark, "op10_bpe", tables)
    t, want = library(), []
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_op4_and_op6(spark, tables, rows):
    got, _ = of(spark, "op4_secrets", tables)
    assert len(got) == len(rows) and {(r.doc_id, *r.secrets) for r in got if r.n_secrets} == {(8, "b7db7aa4a5fcc78305")}
    got, columns = of(spark, "op6_sharding", tables)
    assert columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {r.law for r in got} == {"bytes"}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r.shard for r in got if r.doc_id in (0, 5)}) == 1


def test_op5_links(spark, tables):
    got = {r.vec_id: r for r in of(spark, "op5_embed_dedup", tables)[0]}
    x = np.array([r for r in [list(v) for v in _vectors(spark, tables)]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist() and len(got) == len(x) + 5
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(len(x), len(x) + 5))


def _vectors(spark, d):
    return [np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()[:25]]


def test_op7_op8_op9(spark, tables, rows):
    got = {r.page_id: r for r in of(spark, "op7_url_filter", tables)[0]}
    assert len(got) == 7 and got[0].verdict == "allow" and got[2].rule == "net/es/" and got[5].verdict == "block" and (got[3].host, got[3].path, got[3].rule) == ("", "", None)
    got = {r.record_id: r for r in of(spark, "op8_warc_revisits", tables)[0]}
    assert len(got) == 21 and got[3].url_key == "http://[2001:db8::1]:8080/p?ref=1" and got[4].refers_to == "3" and got[2].status == "mismatch" and got[10].status == "orphan"
    assert {h["key"]: h["value"] for h in json.loads(got[4].headers)}["content-type"] == "text/html"
    got, columns = of(spark, "op9_toxicity", tables)
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("embeddings", "vec_id bigint, embedding array<float>, label int"), ("pages", "page_id bigint, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in QUERIES:
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

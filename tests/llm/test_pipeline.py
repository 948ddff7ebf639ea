"""The pipeline's stages over small tables, each against what brute force keeps."""

import random

import corpus_pipeline
from quillgraph.llm.queries import vocabulary_file


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "ther", "oust", "in", "ed", "ly", "wh", "re"]) for _ in range(rng.randint(1, 4)))
    texts = {i: " ".join(word() for _ in range(rng.randint(40, 200))) for i in range(150)}
    toxic = {i for i in texts if i % 5 == 0}
    for i in toxic:
        texts[i] += " idiot scum"
    for i in range(150, 160):  # near copies of clean texts
        texts[i] = texts[i - 149].rsplit(" ", 1)[0]
    texts[151], texts[156] = texts[1] + " end", texts[6]
    secret = "0641917ea4e9feb9cda83477b57ac2654884f485"
    texts[2] += f' token = "{secret}" there'
    texts[200], texts[201] = None, ""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "packing"]

    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, d)
    left = {r.doc_id: r.text for r in clean.collect()}
    copies_of_toxic = {i for i in range(150, 160) if texts[i] and "idiot" in texts[i]}
    assert clean.columns == docs.columns and set(left) == set(texts) - toxic - copies_of_toxic

    one = corpus_pipeline.near_dedup(spark, clean, d)
    shingles = lambda t: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set()
    sets = {i: shingles(t) for i, t in left.items()}
    dropped = {b for b in sets for a in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == set(left) - dropped and one.columns == docs.columns

    hidden = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, one, d).collect()}
    assert hidden == {i: t and t.replace(secret, "[SECRET]") for i, t in kept.items()}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_file())
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in hidden.items()}
    packed = corpus_pipeline.run(spark, d).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in lengths} == lengths and len({r.doc_id for r in packed}) == len(lengths)
    # pieces of a few hundred tokens need not fill sequences to the last place
    assert len({r.sequence_id for r in packed}) <= -(-sum(lengths.values()) // 2048) + 1

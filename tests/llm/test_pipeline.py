"""The pipeline's stages against brute-force versions of what they keep."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_dedup import brute_classes, brute_lines  # noqa: E402
from test_operators import brute_features  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, item = "This boilerplate line is long enough to be found in many documents", text(30)
    texts = [None, "", "too short", "x y " * 50]
    texts += [text(60) + "\n" + line + "\n" + text(20) for _ in range(8)]
    base = text(200)
    texts += [base, base, base.replace(base.split()[50], "changed"), text(50) + " " + item + " " + text(40), text(40)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(d, t, "en", "s", len(t or ""), "e") for d, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), list(enumerate(texts)), item


def test_stages(spark, corpus):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    keep = [(d, t) for d, t in rows if not brute_features(t)[-1]]
    lines = [(d, x[2]) for d, x in brute_lines(keep).items()]
    classes = brute_classes(lines)
    alone = [(d, t) for d, t in lines if classes[d] == d]
    clean = [(d, t) for d, t in alone if item not in t]
    assert len(rows) > len(keep) > len(alone) > len(clean) and lines != keep
    for (_, stage), expected in zip(corpus_pipeline.STAGES, (keep, lines, alone, clean)):
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == expected and all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    ids = {d: t for d, t in clean}
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(ids)


def test_null_and_repeated_ids(spark, corpus):
    """Every row has a verdict of its own: null ids and several texts of one id are judged, deduplicated and decontaminated one by one."""
    path, _, item = corpus
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    leak = text(40) + " " + item + " " + text(40)
    made = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e") for i, t in rows], SCHEMA)
    ask = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, made(rows), path).collect()), key=repr)
    mixed = [(None, a), (None, "junk"), (5, b), (5, "x y " * 50), (6, c), (None, None), (7, ""), (8, d)]
    assert ask(corpus_pipeline.quality_rules, mixed) == sorted([(None, a), (5, b), (6, c), (8, d)], key=repr)
    twice = [(None, a), (None, a), (None, b), (5, c), (5, d), (6, d), (6, d), (9, a)]
    kept = ask(corpus_pipeline.near_dedup, twice)
    assert sorted(t for _, t in kept) == sorted([a, b, c, d]) and set(kept) <= set(twice)
    assert ask(corpus_pipeline.decontamination, [(None, leak), (None, a), (5, leak), (5, b), (6, c)]) == sorted([(None, a), (5, b), (6, c)], key=repr)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        assert ask(stage, []) == []


def test_run_covers_every_token_once(spark, corpus):
    from tokenizers import Tokenizer

    from folio.llm.queries import tokenizer_path

    path, _, _ = corpus
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = {}
    for r in corpus_pipeline.run(spark, path).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_empty_documents(spark, corpus, tmp_path):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0 and re.match("doc_id", docs.columns[0])


def test_texts_go_to_python_in_small_batches(spark, corpus, monkeypatch):
    """While a stage runs jobs over texts in Python; the session's own setting is back behind it."""
    from folio.llm import packing

    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(key)

    def watch(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, label: found.update({label: spark.conf.get(key)}) or real(df, label))

    watch(corpus_pipeline, "materialise")
    watch(packing, "materialise")
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.packing):
        stage(spark, docs, corpus[0])
        assert spark.conf.get(key) == before != "1000"
    assert {k: found[k] for k in ("copies", "leaked", "tokens")} == dict.fromkeys(("copies", "leaked", "tokens"), "1000")

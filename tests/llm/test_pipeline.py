"""The pipeline's stages against plain versions over small documents."""

import hashlib
import math
import random

import corpus_pipeline
import numpy as np
from fieldtrust.llm import bpe, toxicity
from fieldtrust.llm.common import tokenizer_path
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import key, plain_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(10, 90))]
        if i % 5 == 1:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "v1llain"]))
        elif docs and i % 7 == 0:
            words = docs[rng.randrange(len(docs))][1].split()
            words[rng.randrange(len(words))] = word()
        text = " ".join(words)
        docs.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, i // 2 % 2, int("scoundrel" in text or "v1llain" in text)))
    docs += [(500, None, "en", None, None), (501, "", None, "s1", 0)]
    return docs, labels


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    # The model is fitted by the operator; its decisions are taken again here one text at a time.
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    matcher = toxicity.Matcher(toxicity.fit(frame, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    clean = [d for d in docs if matcher.score(d[1]) < 0.5]
    assert {d[0] for d in docs} - {d[0] for d in clean} == {d[0] for d in docs if d[1] and ("scoundrel" in d[1] or "v1llain" in d[1])}

    classes = brute([(d[0], d[1]) for d in clean])
    single = [d for d, c in zip(clean, classes) if c[0] == c[1]]

    counted = [(d[0], d[3], len((d[1] or "").split())) for d in single]
    sizes = {s: sum(z for _, o, z in counted if o == s) for _, s, _ in counted}
    target, copies = plain_targets(sizes), {}
    weight = {i: (0.5, 2.0)[quality] for i, quality, _ in labels}  # good, bad and unlabelled documents differ
    for source, size in sizes.items():
        epochs = math.floor(target[source] / size) if size else 1
        before = 0
        for _, doc_id, z in sorted((key(d, weight.get(d, 1.0)), d, z) for d, o, z in counted if o == source):
            copies[doc_id] = epochs + (2 * before + z <= 2 * (target[source] - epochs * size) if size else 0)
            before += z

    tokenizer = bpe.TreeEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    want = []
    for d in single:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want += [(d[0], len(ids), digest, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * copies[d[0]]
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0

"""The pipeline's stages, each against plain Python on what the stage before kept."""

import re

import corpus_pipeline
from loomfield.llm import quality, secrets, simhash
from loomfield.llm.common import materialize, table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    labels = table(spark, small, "labels")
    rule, dedup, scan, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = materialize(rule(spark, docs, small), "t1")
    verdicts = {r.doc_id: r["_kept"] for r in quality.judge(docs, labels).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, v in verdicts.items() if v}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert sum(verdicts[i] for i in good if i in verdicts) > 0.9 * len(good & set(verdicts))

    single = materialize(dedup(spark, kept, small), "t2")
    sets = {r.doc_id: set(simhash.shingles(r.text, 5).tolist()) for r in kept.collect()}
    ids, root = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert {r.doc_id for r in single.collect()} == set(root.values())

    clean = materialize(scan(spark, single, small), "t3")
    assert clean.count() == single.count()
    for r in clean.collect():
        text, spans = before[r.doc_id].text, []
        for rule_ in secrets.RULES:
            spans += [m.span() for m in re.finditer(rule_.pattern, text) if len(m[rule_.group]) >= rule_.least]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == (len(r.text) if spans else before[r.doc_id].n_chars)

    packed = pack(spark, clean, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert all(r.length <= 1024 for r in packed)

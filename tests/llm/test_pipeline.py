"""The pipeline against plain versions of its stages, each on its own input."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import corpus_pipeline
from evidara.llm import op5_anchor_pii as op5
from evidara.llm import op7_mixing as op7
from evidara.llm import op8_pigeonhole as op8
from evidara.llm import op9_subword_toxicity as op9
from tests.conftest import SMALL
from tests.llm.helpers import words
from tests.llm.test_operators import bare, distance, near_brute, water


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    outs = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, outs[-1], SMALL).write.parquet(path)
        outs.append(spark.read.parquet(path))
    tables = [o.toPandas() for o in outs]
    assert all(list(t.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for t in tables[:5])
    ids = [set(t.doc_id) for t in tables[:5]]

    model = op9.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = model.score(pa.array(tables[0].text))
    assert ids[1] == set(tables[0].doc_id[np.asarray(score) < op9.THRESHOLD])

    near = near_brute([(r.doc_id, r.text) for r in tables[1].itertuples()])  # two-word sets, as the operator's query
    assert ids[2] == {d for d, _, c in near if d == c} and len(tables[2]) == len(ids[2])

    items = [bare(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = lambda t: all(distance(p, bare(t)) > len(p) // op8.WORDS_PER_EDIT for p in items if len(p) >= op8.LEAST)
    assert ids[3] == {r.doc_id for r in tables[2].itertuples() if clean(r.text)}

    assert ids[4] == ids[3]
    automaton = op5.anchors()
    before = dict(zip(tables[3].doc_id, tables[3].text, strict=True))
    for r in tables[4].itertuples():
        assert r.text == op5.hidden(before[r.doc_id], [s for part in op5.find(before[r.doc_id], automaton) for s in part]) and r.n_chars == len(r.text)

    mixed, size = tables[5], {r.doc_id: len(words(r.text)) for r in tables[4].itertuples()}
    assert set(itertools.chain.from_iterable(mixed.doc_ids)) <= ids[4] and (mixed.n_words == mixed.text.map(lambda t: len(t.split(" ")))).all()
    sizes = collections.Counter()
    for r in tables[4].itertuples():
        sizes[r.source] += size[r.doc_id]
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))})
    taken = mixed.groupby("source").n_words.sum()
    assert all(abs(taken[s] - want[s]) <= op7.BLOCK for s in want)
    text = dict(zip(tables[4].doc_id, tables[4].text, strict=True))
    for r in itertools.islice(mixed.itertuples(), 200):
        assert r.text in " ".join(" ".join(words(text[d])) for d in r.doc_ids)

    whole = corpus_pipeline.run(spark, SMALL).toPandas()
    key = ["shard", "slot"]
    assert whole.drop(columns="doc_ids").sort_values(key).reset_index(drop=True).equals(mixed.drop(columns="doc_ids").sort_values(key).reset_index(drop=True))


def test_stages_survive_awkward_and_empty_tables(spark):
    from tests.llm.helpers import SCHEMA, awkward, empty

    for docs in (awkward(spark)[0].select(*[x.split()[0] for x in SCHEMA.split(", ")]), empty(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= n or stage is corpus_pipeline.mixing

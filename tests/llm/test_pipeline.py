"""The pipeline's stages on the smallest table, each against what it should leave."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from panelkit.llm import surrogates
from panelkit.llm.queries import QUERIES, tokenizer_path
from panelkit.session import load

from .test_operators import words
from .test_whole_job import firsts

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = load(spark, SF_DIR, "documents")
    columns, kept = docs.columns, [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.toPandas())
        assert k == 4 or docs.columns == columns
    start, clean, single, private, mix, ids = kept

    toxic = {r.doc_id for r in QUERIES["op3_toxicity"](spark, SF_DIR).where("predicted = 1").select("doc_id").collect()}
    assert set(clean.doc_id) == set(start.doc_id) - toxic and 0 < len(clean)
    assert sorted(single.doc_id) == firsts(list(zip(clean.doc_id, clean.text)), 5, 80)
    before, after = single.set_index("doc_id").text, private.set_index("doc_id").text
    for d, text in before.items():
        found = [text[a:b] for a, b, *_ in surrogates.mentions(text)]
        assert (after[d] == text) == (not found) and not any(x in after[d] for x in found if len(x) > 6)
    times = Counter(mix.doc_id)
    assert max(times.values()) <= 2 and set(times) <= set(private.doc_id)
    sizes = {s: sum(len(words(t)) for t in g.text) for s, g in private.groupby("source")}
    taken = sum(len(words(t)) for t in mix.text)
    assert abs(taken / sum(sizes.values()) - 1.5) < 0.25
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = Counter(hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for t in mix.text)
    assert Counter(ids.ids_sha256) == want

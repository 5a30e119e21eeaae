"""The pipeline against a brute-force version of its stages."""

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from cairn.llm import bpe, language, queries
from cairn.llm.common import words_of

from .test_duplicates import brute_components
from .test_text import brute_leaks


def without_repeated_lines(rows):
    key = lambda x: x.encode().lower().strip(b" \t\n\v\f\r").decode()
    first = {}
    for d, t in sorted(rows):
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), d)
    return [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d)) for d, t in rows]


def test_pipeline_equals_brute_force(spark, data):
    docs = queries.documents(spark, data)
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}

    known = {r.doc_id for r in language.predict(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known]
    rows = without_repeated_lines(rows)
    first = brute_components(rows)
    rows = [(d, t) for d, t in rows if first[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaked = {d for d, _, _, _ in brute_leaks([(d, t) for d, t in rows if words_of(t)], items)}
    rows = [(d, t) for d, t in rows if d not in leaked]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})

    assert set(got) == {d for d, _ in rows}
    for d, t in rows:
        ids = library.encode_ordinary(t)
        assert got[d][1] == ids and got[d][0] == len(ids)


def test_stages_keep_clean_documents(spark, data):
    """Labelled clean documents that are no copies, hold no benchmark item and have words stay."""
    docs = queries.documents(spark, data)
    left = {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").collect()}
    lost = {r.doc_id for r in docs.select("doc_id").collect()} - left
    known = {r.doc_id for r in language.predict(docs, language.fit(docs)).collect() if r.lang_pred != "und"}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = brute_components(without_repeated_lines(rows))
    leaked = {r.doc_id for r in queries.op7_decontamination(spark, data).collect()}
    assert all(d in leaked or d not in known or first[d][1] != d for d in lost)

"""Each stage against a plain version over the rows that the stage before it kept."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from lorebase.llm import byte_bpe, mixing, quality
from lorebase.llm.common import settle, table

from .conftest import SF
from .test_simhash import survivors


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, SF), "stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(outputs):
    assert all(after.columns == before.columns for before, after in outputs[:-1])


def test_quality_stage(spark, outputs):
    before, after = outputs[0]
    judge = quality.fit(before, table(spark, SF, "labels")).scorer()
    assert ids(after) == Counter(r.doc_id for r in before.collect() if judge(r.text) >= 0.3)
    assert after.count() < before.count()


def test_exact_stage(outputs):
    before, after = outputs[1]
    least = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert ids(after) == Counter(least.values())


def test_near_stage(outputs):
    before, after = outputs[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want, got = Counter(d for d, _ in survivors(rows)), ids(after)
    assert not want - got  # nothing goes without a link
    assert (got - want).total() <= 0.1 * (len(rows) - want.total())  # a tenth of the links may be missed


def test_mixing_stage(spark, outputs):
    from lorebase.llm.queries import TARGETS, labelled_domains

    before, after = outputs[3]
    rows = mixing.mix(before, labelled_domains(before, table(spark, SF, "labels")), TARGETS).collect()
    assert ids(after) == Counter({r.doc_id: r.copies for r in rows})


def test_encoding_stage(outputs):
    before, after = outputs[4]
    bpe = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r.doc_id, hashlib.sha256(bpe.encode(r.text or "")).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == want


def test_run(spark, outputs):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(outputs[-1][1])


def test_stages_take_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, empty, SF).count() == 0

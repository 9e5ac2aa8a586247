import random

import corpus_pipeline
import pytest

from coincide.llm import language


@pytest.mark.parametrize("lang", ["fr", "de"])
def test_language_of_a_clean_text_of_many_megabytes(spark, small, lang):
    """The margin doesn't fall with the length, so the language stage keeps the document."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    parts = sorted(r.text for r in docs.where(docs.lang == lang).collect() if r.text)
    rng, texts = random.Random(3), []
    while sum(map(len, texts)) < 8_000_000:
        words = rng.choice(parts).split()
        at = rng.randrange(len(words))
        texts.append(" ".join(words[at:] + words[:at]))
    text = " ".join(texts)
    held = language.compressors(language.fit(docs))
    short, long = (language.judge(t, held) for t in (text[:30_000], text))
    assert short[0] == long[0] == lang
    assert long[2] > short[2] / 4
    row = docs.limit(1).collect()[0].asDict() | {"doc_id": -1, "text": text, "lang": lang}
    one = spark.createDataFrame([row], docs.schema)
    assert corpus_pipeline.language_id(spark, docs.unionByName(one), small).where("doc_id = -1").count() == 1

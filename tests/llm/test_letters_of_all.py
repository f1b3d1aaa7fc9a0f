"""The character model counts all documents, labelled or not."""

import random
from collections import Counter

from test_operators import frame, words


def test_letters_of_documents_without_labels(spark):
    from graphloom.llm import toxicity

    rng = random.Random(12)
    bad = ["idiot", "moron", "scum"]
    labelled = [words(rng, 30) + (" " + " ".join(rng.sample(bad, 2)) if i % 3 == 0 else "") for i in range(120)]
    others = ["zlotk zlotk zluty"] * 400 + [None, "", "Zlotk " * 3000 + "końcówka", "a_b 3x\n½²z Ⅷ日本 ٣İß ΑΣ"]
    docs = frame(spark, labelled + others)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    want: Counter = Counter()
    for t in labelled + others:
        for w in toxicity.WORD.findall((t or "").lower()):
            p = f"^^{w}$"
            want.update(p[i : i + 3] for i in range(len(w) + 1))
    model = toxicity.train_model(docs, marks)
    assert model.lexicon and model.restore("z1otk") == model.restore("z l 0 t k") == "zlotk" and model.restore("zluuuty") == "zluty"
    assert {"zlo", "ówk"} <= model.grams.keys()
    assert toxicity.train_model(docs, marks.limit(0)).restore("z1otk") == "zlotk"
    assert toxicity.count_trigrams(docs) == want

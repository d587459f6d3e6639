import random

from marlstone.llm import language

from tests.llm.conftest import prose


def test_rare_languages_and_copies_keep_their_place_in_the_sample(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(prose(rng, 12), "big") for _ in range(800)] + [("hot copy " * 9, "big")] * 900 + [(f"rare {prose(rng, 9)}", "rare")] + [(prose(rng, 12), "mid") for _ in range(30)]
    seen = {}
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.update(texts=texts, langs=langs))
    language.fit(spark.createDataFrame(rows, "text string, lang string"), rows=60)
    assert set(seen["langs"]) == {"big", "mid", "rare"} and len(seen["texts"]) <= 60
    assert len(set(zip(seen["texts"], seen["langs"]))) == len(seen["texts"])
    assert seen["langs"].count("mid") >= 20

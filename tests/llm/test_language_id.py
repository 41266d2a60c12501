import numpy as np
import pytest

from loomtext.llm import language_id as li

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF)


def test_held_out_accuracy_and_rejection(spark, docs):
    model = li.fit(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1").toPandas()
    got = li.identify(docs.filter("doc_id % 2 = 1"), model).toPandas().set_index("doc_id")
    rest = rest.set_index("doc_id").join(got, rsuffix="_found")
    taken = rest[rest.accepted]
    assert (taken.lang == taken.lang_found).mean() >= 0.98
    clean = rest[rest.text.str.len() > 200]
    print(model.confidence, model.share, model.temperature, rest.accepted.mean(), clean.accepted.mean())
    assert clean.accepted.mean() >= 0.97
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "敏捷的棕色狐狸跳过了懒狗" * 20, "0101 $$$ 7788 %%% " * 30, "zqxjkv wvxqzj kkqzzx jjxqvv " * 20]
    odd = li.identify(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model)
    assert not any(r.accepted for r in odd.collect())
    rng = np.random.default_rng(2)
    shuffled = ["".join(rng.permutation(list(t[:600]))) for t in clean.text[:60]]
    invented = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(50)) for _ in range(60)]
    for junk in (shuffled, invented):
        odd = li.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model)
        assert odd.filter("accepted").count() <= 3


def test_scores_are_the_definition():
    texts, labels = ["der die das und"] * 6 + ["the and of to in"] * 6, ["de"] * 6 + ["en"] * 6
    model = li.train(texts, labels)
    raw, off = li._pack(["und the", "", "das"])
    total, known, count = li._sums(model, raw, off)
    for i, t in enumerate(["und the", "", "das"]):
        bag = li._bags([t])[0]
        assert count[i] == 0 if not t else np.allclose(total[:, i] / count[i], model.scores[:, bag[0]] @ bag[1], atol=1e-5)


def test_hard_rows(spark, docs):
    model = li.fit(docs)
    rows = [(1, None), (2, ""), (3, "!!! 123"), (None, "the and of the thing that is here with them"), (4, "the and of to in " * 20_000), (4, "the and of to in " * 20_000)]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    assert [(r.lang, r.accepted) for r in got[:3]] == [(None, False)] * 3
    assert [r.lang for r in got[3:]] == ["en"] * 3 and got[4] == got[5]
    clash = docs.selectExpr("doc_id", "text", "lang", "1 AS accepted", "2 AS confidence").limit(3)
    assert clash.filter(li.accepted(spark, model)).columns == clash.columns


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(empty, li.fit(empty)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang, r.accepted) for r in li.identify(unlabelled, li.fit(unlabelled)).collect()] == [(None, False)]

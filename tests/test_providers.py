from pyspark.sql import functions as F

from loomgraph.operators import annotation, linking


class Service:
    name = "svc"

    def annotate(self, text):
        if "fail" in text:
            raise OSError("down")
        return [("u:" + w, w, ["T"], 0.9 if w[0].isupper() else 0.3) for w in text.split()]


def test_texts_are_annotated_once_and_cached(spark):
    texts = spark.createDataFrame([("Ann met bob",), ("Ann met bob",), ("please fail",), (None,), ("Old one",)], "text string")
    old = [("Old", "Old", ["K"], 0.8)]
    cache = spark.createDataFrame([("svc", "Old one", old), ("svc", "Ann met bob", None), ("other", "Ann met bob", old)], f"service string, text string, annotations {annotation.ANNOTATION}")
    cache = cache.withColumn("fetched_at", F.current_timestamp())
    got = {r.text: r.annotations for r in annotation.annotate(texts, Service, cache).collect()}
    assert set(got) == {"Ann met bob", "please fail", "Old one"} and got["please fail"] is None
    assert [a.uri for a in got["Ann met bob"]] == ["u:Ann", "u:met", "u:bob"] and got["Old one"][0].types == ["K"]
    stale = cache.withColumn("fetched_at", F.expr("current_timestamp() - INTERVAL 2 HOURS"))
    assert {r.text: len(r.annotations or []) for r in annotation.annotate(texts, Service, stale).collect()}["Old one"] == 2
    names = spark.createDataFrame([("Ann met bob", "ANN"), ("Ann met bob", "bob"), ("Old one", "none")], "text string, name string")
    assert [(r.name, r.uri) for r in annotation.link_annotated(names, annotation.annotate(texts, Service)).collect()] == [("ANN", "u:Ann")]


class Second:
    def available(self):
        return True

    def answer(self, messages):
        return "2" if "apple" in messages[0][1].lower() else "none of them"


def test_a_provider_decides_between_candidates(spark):
    labels = spark.createDataFrame([("u1", "Apple"), ("u2", "apple"), ("u3", "Pear"), ("u4", "pear"), ("u5", "Fig")], "uri string, label string")
    names = spark.createDataFrame([("apple",), ("pear",), ("fig",)], "name string")
    got = {r.name: r.uri for r in linking.best_links(linking.exact_candidates(names, labels), choose=linking.provider_choice(Second)).collect()}
    assert got == {"apple": "u2", "fig": "u5"}

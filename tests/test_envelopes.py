"""Answers are opened once a row, whatever a query asks of what they hold."""

from pyspark.sql import functions as F

from corpusloom.plans import bind as B
from corpusloom.sources import envelopes as N

ROUTES = [
    (1, '{"result":"{\\"route_entities\\":[{\\"name\\":\\" A \\",\\"aliases\\":[\\"b\\",\\" \\"]},{\\"name\\":\\" \\"}],\\"keywords\\":[\\"k\\"],\\"category_scores\\":{\\"item\\":\\"0.5\\"}}"}'),
    (2, '{"routeEntities":[{"name":"C"},{"name":"D"}],"schema":"no"}'), (3, "none"), (4, None),
]


def test_a_filter_on_a_route_stays_above_its_parsing(spark):
    rows = spark.createDataFrame(ROUTES, "id int, schema string").withColumnRenamed("schema", "body")
    r = N.routes(rows, "body", B.CATEGORIES)
    one = r.where("size(entities) = 1")
    assert [(x.id, x.entities[0].name, x.entities[0].aliases, x.keywords, x.scores["item"], x.schema) for x in one.collect()] == [(1, "A", ["b"], ["k"], 0.5, "l1-route-v1")]
    assert sorted((x.id, len(x.entities)) for x in r.collect()) == [(1, 1), (2, 2), (3, 0), (4, 0)]
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (r, one)]
    assert plans[0].count("parseJson") == plans[1].count("parseJson")


def test_a_filter_on_an_opened_answer_stays_above_its_parsing(spark):
    rows = spark.createDataFrame([(1, '{"output":"[1]"}'), (2, "text"), (3, None)], "id int, v string")
    v = N.opened(rows, F.col("v"), "v")
    some = v.where(N.is_a(F.col("v"), "ARRAY"))
    assert [x.id for x in some.select("id").collect()] == [1] and v.columns == ["id", "v"] and v.select("id").count() == 3
    plans = [d.select("id", N.plain(F.col("v"))).sort("id")._jdf.queryExecution().optimizedPlan().toString() for d in (v, some)]
    assert plans[0].count("parseJson") == plans[1].count("parseJson")

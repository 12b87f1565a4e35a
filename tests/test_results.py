"""Stored results, their getters and endpoints; registered functions."""

import json
import threading
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest

from millrace.functions.register import register, register_table
from millrace.plans.results import Results, serve


@pytest.fixture()
def results(spark, tmp_path):
    r = Results(spark, str(tmp_path))
    r.save("scores", spark.createDataFrame([("a", 3, 1.5), ("b", 5, None), (None, 3, 2.0)], "name string, n int, x double"))
    return r


def test_getters(results):
    assert [r.name for r in results.get("scores", top=(2, "n"), key="x").collect()] == ["b", "a"]
    assert results.get("scores", where={"name": None}).count() == 1 and results.get("scores", least={"x": 1.5}).count() == 2
    assert {(r.key, r.column) for r in results.search(3, {"scores": "name"}).collect()} == {("a", "n"), (None, "n")}
    results.save("scores", results.spark.createDataFrame([("z", 1, 0.0)], "name string, n int, x double"))
    assert results.counts() == {"scores": 1}
    with pytest.raises(KeyError):
        results.read("other")


def test_endpoints(results):
    server = serve(results)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda path: json.loads(urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
    try:
        assert ask("/api/stats") == {"scores": 3}
        assert ask("/api/scores?name=a") == [{"name": "a", "n": 3, "x": 1.5}] and len(ask("/api/scores?limit=2")) == 2
        for path, code in [("/api/none", 404), ("/", 404), ("/api/scores?wrong=1", 400), ("/api/scores?limit=x", 400)]:
            with pytest.raises(HTTPError) as e:
                ask(path)
            assert e.value.code == code
    finally:
        server.shutdown()
        server.server_close()


def test_registered(spark):
    assert "hex_address" in register(spark)
    r = spark.sql("SELECT hex_address(255) AS a, parse_int('0xFF') AS b, parse_int(' 12 ') AS c, parse_int('x') AS d, percentage(1, 3) AS e, is_flag(8) AS f, is_flag(6) AS g, text_length('añb') AS h").first()
    assert tuple(r) == ("0xff", 255, 12, None, 33.33, True, False, 3)

    class Twice:
        def eval(self, n: int):
            for _ in range(2):
                yield (n,)

    register_table(spark, "twice", Twice, "n int")
    assert [r.n for r in spark.sql("SELECT * FROM twice(4)").collect()] == [4, 4]

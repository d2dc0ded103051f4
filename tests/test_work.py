"""Work that a query does besides what its result needs, and calls to a state store, which cost most of a stream's time."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import Row

from crawlens import registry
from crawlens.operators import checks
from crawlens.plans import audit
from crawlens.streaming.site_state import Sites


class State:
    """A value, a list or a map of a state store, that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "exists":
                return self.value is not None
            if name in ("update", "put"):
                self.value = given[0]
            elif name == "clear":
                self.value = None
            elif name in ("get", "iterator"):
                return iter(self.value) if isinstance(self.value, list) else self.value
            return None if name != "containsKey" else False

        return call


def test_a_site_asks_its_state_a_few_times_a_batch():
    calls: list[str] = []
    new = lambda *_: State(calls)
    site = Sites()
    site.init(SimpleNamespace(getValueState=new, getListState=new, getMapState=new, registerTimer=lambda t: None))
    row = lambda i: Row(page_seq=i, status=503 if i % 3 else 200, at=dt.datetime.fromtimestamp(1_700_000_000 + i, dt.UTC))
    times = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    (told,) = site.handleInputRows((1,), iter([row(i) for i in range(500)] * 2), times(0))
    assert (told["pages"], told["longest"], told["run_status"]) == (500, 2, "partial") and len(calls) <= 10
    (told,) = site.handleInputRows((1,), iter([row(i) for i in range(490, 600)]), times(1_700_000_000_000 + 550_000))
    assert told["pages"] == 600 and len(site.waiting.value) == 49 and len(calls) <= 20


def test_checks_that_are_not_asked_for_are_not_worked_out(spark, tmp_path):
    sf = f"file://{tmp_path}"
    shell = '<html lang="en"><head><title>T</title></head><body><div id="root"></div></body></html>'
    long = '<html lang="en"><head><title>T</title></head><body><p>' + "word " * 250 + "</p></body></html>"
    spark.createDataFrame([(1, "http://a.test/x", shell), (2, "http://b.test/y", long), (3, "http://c.test/", long[:90])], "page_id long, url string, html string").coalesce(1).write.parquet(f"{sf}/pages.parquet")
    p = registry.parsed(spark, sf)
    every = checks.page_hits(p)
    for only in (["E11_no_viewport"], audit.DECIDING):
        some = checks.page_hits(p, only)
        assert sorted(some.collect()) == sorted(r for r in every.collect() if r["check_id"] in only) and some.count()
        assert len(some._jdf.queryExecution().optimizedPlan().toString()) < len(every._jdf.queryExecution().optimizedPlan().toString()) / 2
    sites = p.select("site_id").distinct().selectExpr("site_id", "false AS llms_txt", "false AS ai_agents_named")
    rules = registry.proactive_rules(spark, sf)
    assert sorted(rules.collect()) == sorted(audit.proactive(p, audit.graded_findings(p), sites).collect())
    assert "shared by" not in rules._jdf.queryExecution().optimizedPlan().toString()  # checks across pages take no part

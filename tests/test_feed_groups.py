"""The feed's state is kept by groups of pages, and counts what a state by page would."""

import numpy as np
import pandas as pd

from contactloom.operators import views
from contactloom.operators.bucketed import BucketedStore
from contactloom.plans import catalog
from contactloom.streaming import feed


def test_one_call_a_group_of_pages(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "GROUPS", 3, raising=False)
    path = lambda name: str(tmp_path / name)
    leads = catalog.leads(spark, sf_dir)
    kept = BucketedStore(spark, path("store"), buckets=4)
    for change in (lambda: kept.upsert(leads, "reject", "t"), lambda: kept.delete(leads.where("seq % 3 = 0").select("source_url"))):
        change()
        feed.publish(kept, path("feed"))
        run = feed.counts(spark, path("feed"), path("totals"), path("checkpoint"))
        run.awaitTermination()
        assert 0 < run.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 3
        assert feed.totals(spark, path("totals")).collect() == views.kpis(kept.read()).collect()


class _Held:
    def __init__(self):
        self.value, self.updates = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_differences_of_pages_that_share_a_group():
    held, rng = _Held(), np.random.default_rng(3)
    processor = feed._Differences()
    processor.init(held)
    last, total = {}, np.zeros(len(feed.COUNTS), int)
    for batch in range(20):
        # versions ahead, behind and repeated; some pages twice in a frame, some in two frames
        rows = [(f"u{rng.integers(12)}", int(rng.integers(max(0, batch - 3), batch + 2))) for _ in range(15)]
        table = pd.DataFrame([(u, v, *((hash((u, v, k)) % 5) for k in range(len(feed.COUNTS)))) for u, v in rows], columns=["source_url", "version", *feed.COUNTS])
        for r in table.itertuples(index=False):
            if r[1] > last.get(r[0], (-1,))[0]:
                last[r[0]] = tuple(r[1:])
        for found in processor.handleInputRows(None, iter([table[:9], table[9:9], table[9:]]), None):
            total += found[feed.COUNTS].to_numpy().sum(axis=0)
        assert total.tolist() == np.sum([x[1:] for x in last.values()], axis=0).tolist()
    before = held.updates
    assert list(processor.handleInputRows(None, iter([table]), None)) == [] and held.updates == before

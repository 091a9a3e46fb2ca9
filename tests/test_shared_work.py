"""Work that several steps of a query need is done once, whatever the number of steps."""

from registry import frames, results
from tests.conftest import SF_SMALL


def test_result_rows_draw_the_leaks_once(spark, monkeypatch):
    """Scores, shares and predictions read the same written orders."""
    built = []
    leaky = frames.leaky_orders
    monkeypatch.setattr(frames, "leaky_orders", lambda *a: built.append(1) or leaky(*a))
    found = results.deploy_drop(spark, SF_SMALL)
    assert len(built) == 1 and "md5" in str(leaky(spark, SF_SMALL, 1.0)._jdf.queryExecution().optimizedPlan())
    rows = frames.split_leaky_orders(spark, SF_SMALL, several_uses=True)
    again = frames.split_leaky_orders(spark, SF_SMALL)
    assert rows.columns == again.columns and rows.exceptAll(again).isEmpty() and again.exceptAll(rows).isEmpty()
    assert found.count() > 0


def test_shares_are_looked_up_before_rows_are_copied_for_methods(spark):
    rows = frames.split_leaky_orders(spark, SF_SMALL, several_uses=True)
    found = frames.predictions(rows, frames.rankings(spark, SF_SMALL, rows=rows))
    lines = str(found._jdf.queryExecution().optimizedPlan()).splitlines()
    copied = next(i for i, line in enumerate(lines) if "explode(choices" in line)
    looked_up = [i for i, line in enumerate(lines) if "try_element_at" in line or "element_at(of_" in line]
    assert looked_up and min(looked_up) > copied

import pytest

from pulsegrid.models.forest import IsolationForest
from pulsegrid.operators import attribution as at
from pulsegrid.workloads import model_queries as mq
from pulsegrid.workloads.registry import QUERIES


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["shap_per_window", "shap_importance", "failure_attribution"])
def test_the_scoring_model_is_explained(spark, monkeypatch, name):
    asked, whole = {}, at.shap_values

    def noted(model, vectors, background=None, n_background=500, seed=42):
        asked.update(trees=model.nodes.select("tree").distinct().count(), rows=n_background)
        raise Asked

    monkeypatch.setattr(at, "shap_values", noted)
    with pytest.raises(Asked):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == {"trees": mq.TREES, "rows": whole.__defaults__[1]}

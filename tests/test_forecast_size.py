"""The registered model queries fit the declared sizes."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stockweave.queries import REGISTRY, forecast  # noqa: E402
from stockweave.schemas import ForecastParams  # noqa: E402


class Fitted(Exception):
    pass


def fitted(monkeypatch, name):
    """The parameters and names that a query fits."""

    def fit(rows, p=ForecastParams(), names=forecast.fc.MODEL_NAMES):
        raise Fitted(p, tuple(names))

    class Rows:
        cache = lambda self: self

    class Tables:
        sales = None

    for f in ("fit_sku_models", "fit_range_model"):
        monkeypatch.setattr(forecast.fc, f, fit)
    for f in ("training_rows", "range_training_rows"):
        monkeypatch.setattr(forecast.fc, f, lambda *a: Rows())
    monkeypatch.setattr(forecast, "_ser_sales", lambda t: None)
    monkeypatch.setattr(forecast, "_checkpoints", lambda t: None)
    with pytest.raises(Fitted) as found:
        REGISTRY[name].run(Tables())
    return found.value.args


@pytest.mark.parametrize("name", ["ml_07_boosting", "ml_08_boosting_gama"])
def test_boosting_has_its_full_size(monkeypatch, name):
    assert fitted(monkeypatch, name)[0] == ForecastParams()


def test_summary_chooses_among_all_models(monkeypatch):
    assert fitted(monkeypatch, "ml_13_resumen") == (ForecastParams(), forecast.fc.MODEL_NAMES)

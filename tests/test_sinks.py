"""Charts and downloads."""

import xml.etree.ElementTree as xml

import pandas as pd
import pytest

from regimelab.config import CONFIG
from regimelab.sources import download, figures, tables


def test_charts_are_drawn_from_points():
    panel = figures.Panel("a < b", [("x", [(0, 1.0), (1, 10.0), (2, None)]), ("y", [(0, 2.0), (2, float("nan"))])], [(0, 0.5, 1.5), (1, None, 2)], [(0, 1, "#fff")], log=True)
    drawn = xml.fromstring(figures.line_chart([panel, figures.Panel("none", [("z", [])])], 2))
    lines = [e for e in drawn.iter() if e.tag.endswith("polyline")]
    assert len(lines) == 2 and len(lines[0].attrib["points"].split()) == 2 and any(e.text == "a < b" for e in drawn.iter())
    bars = xml.fromstring(figures.bar_chart("t", ["p", "q"], [("s", {"p": 1.0, "q": -2.0}), ("r", {"p": 0.5})]))
    assert sum(e.tag.endswith("title") for e in bars.iter()) == 3
    heat = xml.fromstring(figures.heat_map("t", ["a"], ["b", "c"], {("a", "b"): 0.25}, 0, 1))
    assert [e.text for e in heat.iter() if e.text == "0.25"] == ["0.25"]


def test_every_figure_of_the_study_is_written(spark, tmp_path):
    from regimelab import catalog

    found = figures.write_figures(catalog._study(spark, "/root/testdata/sf0.01"), f"file://{tmp_path}")
    assert set(found.values()) == {"done"} and len(found) == 10, found
    for name in found:
        assert len(list(xml.parse(tmp_path / name).iter())) > 10


def test_download_tries_again_flattens_and_goes_on(spark, tmp_path):
    calls = []

    def fetch(ticker, start):
        calls.append(ticker)
        days = pd.to_datetime(["2020-01-02", "2020-01-03"])
        if ticker == "QQQ":
            raise OSError("down")
        if ticker == "IWM" and calls.count("IWM") < 3:
            return pd.DataFrame()
        columns = [c for c in CONFIG.columns if not (ticker == "XLK" and c == "Volume")]
        return pd.DataFrame(1.5, days, pd.MultiIndex.from_product([columns, [ticker]]))

    found = download.download(str(tmp_path), fetch=fetch, wait=0)
    assert found["QQQ"] == "failed: OSError: down" and calls.count("QQQ") == 3 and found["IWM"] == "saved" and calls.count("IWM") == 3
    assert found["XLK"] == "saved without Volume" and set(found) == set(tables.tickers(False)) and "BTC-USD" in tables.tickers(True)
    assert tables.read_prices(spark, str(tmp_path), strict=False).where("ticker = '^VIX'").count() == 2
    with pytest.raises(RuntimeError):
        download.default_fetch("SPY", "2020-01-01")

"""Daily bars from a market data service, one CSV a ticker: `python -m regimelab.sources.download FOLDER [--extended] [--start DATE]`.

The service is a function of ticker and first date that returns a table by date; the default one needs a package that is
not part of this repository, and a network.
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable

import pandas as pd

from ..config import CONFIG
from ..operators.quality import schema_findings
from .tables import stem, tickers

START, TRIES = "2000-01-01", 3  # fixed values: the study's first date and number of attempts
Fetch = Callable[[str, str], pd.DataFrame]


def flattened(table: pd.DataFrame) -> pd.DataFrame:
    """The table with plain column names, where a service returns (field, ticker) pairs."""
    if isinstance(table.columns, pd.MultiIndex):
        table = table.set_axis(table.columns.get_level_values(0), axis=1)
    return table


def default_fetch(ticker: str, start: str) -> pd.DataFrame:
    try:
        import yfinance
    except ImportError as gone:
        raise RuntimeError("no market data service is installed; pass one as `fetch`") from gone
    return yfinance.download(ticker, start=start, auto_adjust=False, progress=False)


def fetched(ticker: str, start: str, fetch: Fetch, wait: float = 2.0) -> tuple[pd.DataFrame | None, str]:
    """A table that holds rows, or None and the last reason, after up to TRIES attempts with growing pauses."""
    reason = ""
    for attempt in range(1, TRIES + 1):
        try:
            table = flattened(fetch(ticker, start))
            if len(table):
                return table, ""
            reason = "no rows"
        except Exception as error:  # noqa: BLE001 - any failure of the service is tried again
            reason = f"{type(error).__name__}: {error}"
        if attempt < TRIES:
            time.sleep(wait * attempt)
    return None, reason


def download(folder: str, extended: bool = False, start: str = START, fetch: Fetch = default_fetch, wait: float = 2.0) -> dict[str, str]:
    """Writes a CSV for each ticker, and says of each whether it is saved, lacks columns, or failed and why."""
    os.makedirs(folder, exist_ok=True)
    out = {}
    for ticker in tickers(extended):
        table, reason = fetched(ticker, start, fetch, wait)
        if table is None:
            out[ticker] = f"failed: {reason}"
            continue
        lost = schema_findings(list(table.columns))
        table.rename_axis("Date").to_csv(f"{folder}/{stem(ticker)}.csv")
        out[ticker] = f"saved without {', '.join(lost)}" if lost else "saved"
    return out


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Daily bars, one CSV a ticker.")
    parser.add_argument("folder")
    parser.add_argument("--extended", action="store_true", help=f"also {', '.join(CONFIG.extension)}")
    parser.add_argument("--start", default=START)
    asked = parser.parse_args(arguments)
    found = download(asked.folder, asked.extended, asked.start)
    for ticker, state in found.items():
        print(f"{ticker}: {state}")
    return int(any(state.startswith("failed") for state in found.values()))


if __name__ == "__main__":
    raise SystemExit(main())

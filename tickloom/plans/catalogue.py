"""All queries of the engine and their SQL."""

from __future__ import annotations

from tickloom.plans import axes, axes_oracle, backtest_oracle, backtest_queries, files, files_oracle, oracle, queries, records, records_oracle, reports, reports_oracle, universes, universes_oracle

QUERIES = {**queries.QUERIES, **backtest_queries.QUERIES, **reports.QUERIES, **records.QUERIES, **universes.QUERIES, **axes.QUERIES, **files.QUERIES}
SQL = {**oracle.SQL, **backtest_oracle.SQL, **reports_oracle.SQL, **records_oracle.SQL, **universes_oracle.SQL, **axes_oracle.SQL, **files_oracle.SQL}

"""Feature stage: fit statistics on training logs, transform any log batch.

``fit`` plans three tables (endpoint shares, per-client stats, the median
latency); ``transform`` is one plan: the request rate and the client lookup
on the distinct (client, time) key table, one join of that table back to the
rows, the endpoint lookup, the row-local formulas, then +-inf -> null and
median imputation with medians of the batch being transformed (per
``partition_cols`` group).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions import features as fx
from loglens.operators import rate, stats
from loglens.operators.quantiles import quantile_values
from loglens.schema import FEATURE_COLUMNS, RATE_WINDOW_SECONDS
from loglens.session import persist_for_reuse


@dataclass
class FeatureBuilder:
    rate_window_seconds: int = RATE_WINDOW_SECONDS
    endpoint_freq: DataFrame | None = None
    ip_stats: DataFrame | None = None
    median: DataFrame | None = None  # one row: global_median_latency
    rate_method: str = "bucketed"

    @property
    def fitted(self) -> bool:
        return self.endpoint_freq is not None and self.ip_stats is not None and self.median is not None

    def fit(self, train: DataFrame) -> FeatureBuilder:
        self.endpoint_freq = stats.fit_endpoint_freq(train)
        self.ip_stats = stats.fit_ip_stats(train)
        self.median = stats.fit_median_latency(train)
        return self

    def raw_features(self, df: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
        """Input columns + the 14 features before imputation (+-inf already null)."""
        if not self.fitted:
            raise RuntimeError("FeatureBuilder is not fitted; call fit() before transform()")
        # rate and client statistics depend on (client, time) only: attach both
        # to the narrow key table, then join it back to the rows once
        key_cols = [*partition_cols, "client_ip", "timestamp"]
        keys = rate.key_table(df, partition_cols=partition_cols)
        keyed = rate.rate_table(keys, self.rate_window_seconds, partition_cols=partition_cols,
                                method=self.rate_method).drop("_rr_n")
        keyed = stats.lookup_ip_stats(keyed, self.ip_stats, self.median)
        out = rate.join_keys(df, keyed, key_cols)
        out = stats.lookup_endpoint_freq(out, self.endpoint_freq)
        out = out.withColumns({
            "response_time_log1p": fx.log1p_clipped("response_time_ms"),
            "status_class": fx.status_class("status_code"),
            "is_5xx": fx.is_5xx("status_code"),
            "is_4xx": fx.is_4xx("status_code"),
            **fx.time_cycle("timestamp"),
            "method_code": fx.method_code("http_method"),
            "bytes_sent_log1p": fx.log1p_clipped("bytes_sent"),
        })
        return out.withColumns({c: fx.finite_or_null(c) for c in FEATURE_COLUMNS})

    def transform(self, df: DataFrame, partition_cols: Sequence[str] = (),
                  impute_columns: Sequence[str] | None = None, stage=None) -> DataFrame:
        """Input columns + 14 double features, nulls filled with batch medians.

        ``impute_columns=None`` finds the feature columns holding nulls with one
        aggregate over the staged raw features and computes exact medians only
        for those; pass a list to skip that check.  ``stage`` turns the raw
        features into a frame that can be read more than once (default: a
        persisted frame; jobs pass a writer of a Parquet table).
        """
        raw = self.raw_features(df, partition_cols)
        if impute_columns is None:
            raw = (stage or persist_for_reuse)(raw)
            counts = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURE_COLUMNS]).first()
            impute_columns = [c for c in FEATURE_COLUMNS if counts[c] > 0]
        return impute_with_medians(raw, impute_columns, partition_cols)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def impute_with_medians(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Fill nulls in ``columns`` with the exact median of the same group.

    The medians (one per group and column; groups are few, e.g. the three
    splits) are computed now and enter the plan as literals.
    """
    columns = list(columns)
    if not columns:
        return df
    vals = quantile_values(df, columns, [0.5], group_cols)
    fills = {}
    for c in columns:
        if not group_cols:
            m = vals.get((c,), {}).get(0.5)
            fills[c] = F.lit(m).cast("double")
            continue
        expr = None
        for key, d in vals.items():
            if key[-1] != c:
                continue
            match = None
            for g, v in zip(group_cols, key[:-1]):
                m = F.col(g).eqNullSafe(F.lit(v))
                match = m if match is None else match & m
            expr = F.when(match, F.lit(d[0.5])) if expr is None else expr.when(match, F.lit(d[0.5]))
        fills[c] = expr.cast("double") if expr is not None else F.lit(None).cast("double")
    return df.withColumns({c: F.coalesce(F.col(c), fills[c]) for c in columns})


def feature_matrix(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Selected key columns + the 14 features in their fixed order."""
    return features.select(*keep, *FEATURE_COLUMNS)

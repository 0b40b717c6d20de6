"""DuckDB text for the cleaning rules, used to build oracle queries.

Written from the rules with DuckDB's own parsing functions; it shares no pattern with the engine.
"""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_all(e: str) -> str:
    return f"trim({e}, {BLANKS})"


def parse_double(e: str) -> str:
    x = f"try_cast({strip_all(e)} AS DOUBLE)"
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def parse_bigint(e: str) -> str:
    s = strip_all(e)
    whole = f"try_cast({s} AS HUGEINT)"
    return (f"(CASE WHEN contains({s}, '.') OR contains(lower({s}), 'e') "
            f"THEN try_cast(trunc({parse_double(e)}) AS BIGINT) ELSE try_cast({whole} AS BIGINT) END)")


def parse_timestamp(e: str) -> str:
    s = strip_all(e)
    return (f"coalesce(try_strptime({s}, ['%Y%m%dT%H%M%S.%f', '%Y%m%dT%H%M%S', '%Y%m%dT%H%M', '%Y%m%d']), "
            f"try_cast({s} AS TIMESTAMP))")


def parse_flag(e: str) -> str:
    s = f"lower({strip_all(e)})"
    return f"coalesce(CASE WHEN {s} = 'true' THEN 1 WHEN {s} = 'false' THEN 0 END, try_cast(trunc({parse_double(e)}) AS INTEGER), 0)"


def clean_text(e: str, upper: bool = False) -> str:
    s = f"coalesce(CAST({e} AS VARCHAR), 'nan')"
    return strip_all(f"upper({s})" if upper else s)


PARSED_RAW = f"""
SELECT event_id,
 {parse_timestamp('"timestamp"')} AS "timestamp",
 {clean_text('client_ip')} AS client_ip,
 {clean_text('endpoint_uri')} AS endpoint_uri,
 {clean_text('http_method', upper=True)} AS http_method,
 {parse_double('response_time')} AS response_time_ms,
 {parse_double('status_code')} AS status_code,
 {parse_bigint('bytes_sent')} AS bytes_sent,
 {parse_flag('is_anomaly')} AS is_anomaly,
 coalesce(anomaly_type, 'normal') AS anomaly_type
FROM raw
"""

VALID = ("\"timestamp\" IS NOT NULL AND response_time_ms IS NOT NULL AND status_code IS NOT NULL "
         "AND bytes_sent IS NOT NULL AND status_code >= 100 AND status_code < 600")

CLEAN_FROM_PARSED = f"""
SELECT event_id, "timestamp", client_ip, endpoint_uri, http_method,
 greatest(response_time_ms, 0.0) AS response_time_ms,
 CAST(trunc(status_code) AS INTEGER) AS status_code,
 bytes_sent, is_anomaly, anomaly_type
FROM parsed WHERE {VALID}
"""

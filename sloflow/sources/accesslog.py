"""Proxy access-log records (HTTP and TCP) to raw events.

Records are nested structs as landed from the log service: a message holds either a list of HTTP
entries or a list of TCP entries.  Absent sub-messages are NULL; absent scalars count as empty text
or zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.text import nanoseconds_text, number_text, rfc3339

# Record fields and the metadata keys they become.
ADDRESSES = {
    "downstream_direct_remote_address": "downstreamDirectRemote",
    "downstream_remote_address": "downstreamRemote",
    "downstream_local_address": "downstreamLocal",
    "upstream_local_address": "upstreamLocal",
    "upstream_remote_address": "upstreamRemote",
}
DURATIONS = {
    "time_to_first_downstream_tx_byte": "timeToFirstDownstreamTxByte",
    "time_to_first_upstream_rx_byte": "timeToFirstUpstreamRxByte",
    "time_to_first_upstream_tx_byte": "timeToFirstUpstreamTxByte",
    "time_to_last_downstream_tx_byte": "timeToLastDownstreamTxByte",
    "time_to_last_rx_byte": "timeToLastRxByte",
    "time_to_last_upstream_rx_byte": "timeToLastUpstreamRxByte",
    "time_to_last_upstream_tx_byte": "timeToLastUpstreamTxByte",
}
COMMON_TEXTS = {
    "route_name": "routeName",
    "upstream_cluster": "upstreamCluster",
    "upstream_transport_failure_reason": "upstreamTransportFailureReason",
}
REQUEST_TEXTS = {
    "authority": "authority",
    "forwarded_for": "forwardedFor",
    "original_path": "originalPath",
    "path": "path",
    "referer": "referer",
    "request_id": "requestId",
    "request_method": "requestMethod",
    "scheme": "scheme",
    "user_agent": "userAgent",
}
REQUEST_NUMBERS = {
    "request_body_bytes": "requestBodyBytes",
    "request_headers_bytes": "requestHeadersBytes",
}
RESPONSE_TEXTS = {"response_code_details": "responseCodeDetails"}
RESPONSE_NUMBERS = {
    "response_body_bytes": "responseBodyBytes",
    "response_code": "responseCode",
    "response_headers_bytes": "responseHeadersBytes",
}
TCP_NUMBERS = {"received_bytes": "receivedBytes", "sent_bytes": "sentBytes"}

_MAX_DURATION_SECONDS = 315_576_000_000
_FIRST_SECOND = -62_135_596_800
_LAST_SECOND = 253_402_300_799

_ADDRESS_TYPE = "struct<socket_address:struct<address:string,port_value:bigint>>"
_DURATION_TYPE = "struct<seconds:bigint,nanos:int>"


def _struct(parts: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in parts.items()) + ">"


COMMON_TYPE = _struct(
    {name: _ADDRESS_TYPE for name in ADDRESSES}
    | {name: _DURATION_TYPE for name in DURATIONS}
    | {name: "string" for name in COMMON_TEXTS}
    | {"start_time": _DURATION_TYPE, "sample_rate": "double"}
)
REQUEST_TYPE = _struct(
    {name: "string" for name in REQUEST_TEXTS}
    | {name: "bigint" for name in REQUEST_NUMBERS}
    | {"request_headers": "map<string,string>"}
)
RESPONSE_TYPE = _struct(
    {name: "string" for name in RESPONSE_TEXTS}
    | {name: "bigint" for name in RESPONSE_NUMBERS}
    | {"response_headers": "map<string,string>", "response_trailers": "map<string,string>"}
)
HTTP_TYPE = _struct(
    {
        "common_properties": COMMON_TYPE,
        "protocol_version": "string",
        "request": REQUEST_TYPE,
        "response": RESPONSE_TYPE,
    }
)
TCP_TYPE = _struct(
    {"common_properties": COMMON_TYPE, "connection_properties": _struct({n: "bigint" for n in TCP_NUMBERS})}
)
BATCH_TYPE = f"http_logs array<{HTTP_TYPE}>, tcp_logs array<{TCP_TYPE}>"


def _valid_duration(d: Column) -> Column:
    return (
        (F.abs(d["seconds"]) <= _MAX_DURATION_SECONDS)
        & (F.abs(d["nanos"]) < 1_000_000_000)
        & ~((d["seconds"] > 0) & (d["nanos"] < 0))
        & ~((d["seconds"] < 0) & (d["nanos"] > 0))
    )


def _valid_time(t: Column) -> Column:
    return t["seconds"].between(_FIRST_SECOND, _LAST_SECOND) & t["nanos"].between(0, 999_999_999)


def _duration_text(d: Column) -> Column:
    exact = d["seconds"].cast("decimal(20,0)") * 1_000_000_000 + d["nanos"]
    bounded = F.least(
        F.greatest(exact, F.lit(-(2**63)).cast("decimal(31,0)")), F.lit(2**63 - 1).cast("decimal(31,0)")
    )
    return F.when(_valid_duration(d), nanoseconds_text(bounded))


def _texts(record: Column, names: dict[str, str]) -> dict[str, Column]:
    return {key: F.coalesce(record[field], F.lit("")) for field, key in names.items()}


def _numbers(record: Column, names: dict[str, str]) -> dict[str, Column]:
    return {
        key: F.coalesce(record[field], F.lit(0)).cast("string") for field, key in names.items()
    }


def _prefixed(m: Column, prefix: str) -> Column:
    return F.transform_keys(strmap.or_empty(m), lambda key, _: F.concat(F.lit(prefix), key))


def _fixed(columns: dict[str, Column]) -> Column:
    """Map of columns that are never NULL."""
    return F.create_map(*[part for key, c in columns.items() for part in (F.lit(key), c)])


def _optional(common: Column) -> dict[str, Column]:
    """Addresses, durations and start time; NULL where absent or invalid."""
    columns: dict[str, Column] = {}
    for field, key in ADDRESSES.items():
        socket = common[field]["socket_address"]
        columns[f"{key}Address"] = F.when(socket.isNotNull(), F.coalesce(socket["address"], F.lit("")))
        columns[f"{key}Port"] = F.when(
            socket.isNotNull(), F.coalesce(socket["port_value"], F.lit(0)).cast("string")
        )
    for field, key in DURATIONS.items():
        columns[key] = _duration_text(common[field])
    start = common["start_time"]
    columns["startTime"] = F.when(_valid_time(start), rfc3339(F.timestamp_seconds(start["seconds"])))
    return columns


def _always(common: Column) -> dict[str, Column]:
    """Route, cluster, failure reason and sample rate."""
    rate = number_text(F.coalesce(common["sample_rate"], F.lit(0.0)), exponents=False)
    return _texts(common, COMMON_TEXTS) | {"sampleRate": rate}


def skipped_fields(common: Column) -> Column:
    """How many addresses, durations and times of a record had to be left out."""
    unsupported = [
        (common[f].isNotNull() & common[f]["socket_address"].isNull()).cast("int") for f in ADDRESSES
    ]
    invalid = [(common[f].isNotNull() & ~_valid_duration(common[f])).cast("int") for f in DURATIONS]
    start = common["start_time"]
    return F.struct(
        sum(unsupported[1:], unsupported[0]).alias("unsupported_addresses"),
        sum(invalid[1:], invalid[0]).alias("invalid_durations"),
        (start.isNotNull() & ~_valid_time(start)).cast("int").alias("invalid_timestamps"),
    )


def http_metadata(entry: Column) -> Column:
    request, response = entry["request"], entry["response"]
    common = entry["common_properties"]
    always = (
        _always(common)
        | {"protocolVersion": F.coalesce(entry["protocol_version"], F.lit(""))}
        | _texts(request, REQUEST_TEXTS)
        | _numbers(request, REQUEST_NUMBERS)
        | _texts(response, RESPONSE_TEXTS)
        | _numbers(response, RESPONSE_NUMBERS)
    )
    parts = [
        strmap.from_columns(_optional(common)),
        _fixed(always),
        _prefixed(request["request_headers"], "http_"),
        _prefixed(response["response_headers"], "sent_http_"),
        _prefixed(response["response_trailers"], "sent_trailer_"),
    ]
    return F.map_concat(*parts)


def tcp_metadata(entry: Column) -> Column:
    common = entry["common_properties"]
    always = _always(common) | _numbers(entry["connection_properties"], TCP_NUMBERS)
    return F.map_concat(strmap.from_columns(_optional(common)), _fixed(always))


def explode_log_batches(df: DataFrame) -> DataFrame:
    """One raw event per entry of ``http_logs``, or of ``tcp_logs`` where there are no HTTP logs."""
    no_http = F.lit(None).cast(HTTP_TYPE)
    no_tcp = F.lit(None).cast(TCP_TYPE)
    entries = F.coalesce(
        F.transform("http_logs", lambda e: F.struct(e.cast(HTTP_TYPE).alias("http"), no_tcp.alias("tcp"))),
        F.transform("tcp_logs", lambda e: F.struct(no_http.alias("http"), e.cast(TCP_TYPE).alias("tcp"))),
    )
    keep = [c for c in df.columns if c not in ("http_logs", "tcp_logs")]
    found = df.select(*keep, F.posexplode_outer(entries).alias("entry", "__entry"))
    http, tcp = F.col("__entry.http"), F.col("__entry.tcp")
    return found.filter(F.col("__entry").isNotNull()).withColumns(
        {
            "log_type": F.when(http.isNotNull(), F.lit("HTTP")).otherwise(F.lit("TCP")),
            "metadata": F.when(http.isNotNull(), http_metadata(http)).otherwise(tcp_metadata(tcp)),
            "quantity": F.lit(1.0),
        }
    ).drop("__entry")


def unknown_batches(df: DataFrame) -> DataFrame:
    return df.filter(F.col("http_logs").isNull() & F.col("tcp_logs").isNull())

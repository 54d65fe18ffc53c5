"""Captured processes, sockets and node answers, matched as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import OBJECT, as_text
from ..functions.timestamps import decode_ipv4

# The engines' main classes, and the socket states that listen.
ENGINE_CLASS = "(?i)org.(easy|elastic|open)search.bootstrap.(Easy|Elastic|Open)Search"
LISTEN_STATES = (0x0A, 0x06)

_SOCKET = (
    r"^\s*(\d+):\s*(\S+)\s+(\S+)\s+([0-9A-Fa-f]{2})\s+(\S+)\s+(\S+)\s+([0-9A-Fa-f]{1,8})\s+(\d+)"
)


def filter_engine_processes(processes: DataFrame, keep: Column | None = None) -> DataFrame:
    """Processes whose command line names an engine, or any other condition."""
    return processes.filter(keep if keep is not None else F.col("cmdline").rlike(ENGINE_CLASS))


def parse_sockets(lines: DataFrame, line: str = "line") -> DataFrame:
    """Listening ``uid, ip, port`` of socket-table lines; header and bad lines go.

    Long addresses are read by their last eight hex digits, the loopback in
    them included; the number is little-endian.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(line, _SOCKET, i)

    address = F.split(part(2), ":")
    hex_ip = F.get(address, F.lit(0))
    hex_ip = F.when(F.length(hex_ip) > 24, F.substr(hex_ip, F.lit(25))).otherwise(hex_ip)
    state = F.conv(part(4), 16, 10).cast("int")
    ip = decode_ipv4(F.coalesce(F.conv(hex_ip, 16, 10), F.lit("0")), "little")
    rows = lines.filter(F.col(line).rlike(_SOCKET)).filter(state.isin(*LISTEN_STATES) & (F.size(address) == 2))
    return rows.withColumns(
        {
            "uid": part(8).cast("bigint"),
            "ip": ip,
            "port": F.conv(F.get(address, F.lit(1)), 16, 10).cast("int"),
        }
    )


def attach_listen_addresses(processes: DataFrame, connections: DataFrame, sockets: DataFrame) -> DataFrame:
    """Add ``addresses`` in capture order; processes without any are dropped.

    Listening connections of the process come first; where it has none, the
    sockets of its user on the same host stand in. Both sides are reduced to
    distinct addresses before they meet a process, so a chatty host costs one
    row per address.
    """

    def listed(rows: DataFrame, *owner: str) -> DataFrame:
        distinct = rows.groupBy("host_id", *owner, "ip", "port").agg(F.min("seq").alias("seq"))
        entry = F.struct(F.col("seq"), F.col("ip"), F.col("port"))
        return distinct.groupBy("host_id", *owner).agg(F.array_sort(F.collect_list(entry)).alias("_found"))

    own = listed(connections.filter(F.col("status") == "LISTEN"), "pid").withColumnRenamed("_found", "_own")
    shared = listed(sockets, "uid").withColumnRenamed("_found", "_shared")
    joined = processes.join(own, ["host_id", "pid"], "left").join(shared, ["host_id", "uid"], "left")
    found = F.coalesce("_own", "_shared")
    return (
        joined.filter(found.isNotNull())
        .withColumn("addresses", F.transform(found, lambda a: F.struct(a["ip"].alias("ip"), a["port"].alias("port"))))
        .drop("_own", "_shared")
    )


def _spaced(name: str, cmdline: str) -> Column:
    found = F.regexp_extract(cmdline, rf"-Des\.path\.{name}=(.*?)\s+", 1)
    return found


def _argument(name: str, cmdline: str) -> Column:
    hits = F.filter(F.split(cmdline, " "), lambda a: a.startswith(f"-Des.path.{name}"))
    value = F.get(F.split(F.get(hits, F.lit(0)), "="), F.lit(1))
    return F.coalesce(F.replace(value, F.lit('"'), F.lit("")), F.lit(""))


def extract_paths(processes: DataFrame, quoted: bool = False, cmdline: str = "cmdline") -> DataFrame:
    """Home and config directories from the command line, empty when absent.

    By default a value must be followed by white space; with ``quoted`` the line
    is cut at spaces and double quotes are removed.
    """
    read = _argument if quoted else _spaced
    return processes.withColumns({"path_home": read("home", cmdline), "path_conf": read("conf", cmdline)})


def _decisive(processes: DataFrame, probes: DataFrame, port: int | None) -> DataFrame:
    """The first address of each process that settled the question."""
    tried = processes.select("host_id", "pid", F.posexplode("addresses").alias("pos", "_a"))
    tried = tried.select("host_id", "pid", "pos", "_a.ip", "_a.port")
    if port is not None:
        tried = filter_port(tried, port)
    answers = probes.filter((F.col("status") == "unauthorized") | (F.col("cluster_uuid") != ""))
    hits = tried.join(answers, ["host_id", "ip", "port"])
    settled = F.min_by(F.struct("ip", "port", "status", "node_id", "node_pid", "cluster_uuid"), "pos")
    return hits.groupBy("host_id", "pid").agg(settled.alias("_s")).select("host_id", "pid", "_s.*")


def reconcile_nodes(processes: DataFrame, probes: DataFrame, port: int | None = None) -> DataFrame:
    """Processes that are the node answering at their first answering address."""
    settled = _decisive(processes, probes, port)
    return settled.filter((F.col("status") == "ok") & (F.col("node_pid") == F.col("pid"))).drop("status", "node_pid")


def unknown_processes(
    processes: DataFrame, probes: DataFrame, found: DataFrame | None = None, port: int | None = None
) -> DataFrame:
    """Processes whose probe was refused and that are no found node."""
    refused = _decisive(processes, probes, port).filter(F.col("status") == "unauthorized").select("host_id", "pid")
    known = found if found is not None else reconcile_nodes(processes, probes, port)
    return refused.join(known.select("host_id", "pid"), ["host_id", "pid"], "left_anti")


def filter_port(addresses: DataFrame, port: int | None) -> DataFrame:
    """Keep one port when it is set; 0 or less means it is not."""
    return addresses if port is None or port <= 0 else addresses.filter(F.col("port") == port)


def parse_bound_addresses(df: DataFrame, address: str = "address") -> DataFrame:
    """``ip`` and ``port`` around the last colon; no colon, no row."""
    shape = r"^([\s\S]*):([^:]*)$"
    digits = F.regexp_extract(address, shape, 2)
    return df.filter(F.col(address).contains(":")).withColumns(
        {
            "ip": F.regexp_extract(address, shape, 1),
            "port": F.when(digits.rlike("^[+-]?\\d{1,9}$"), digits.cast("int")).otherwise(F.lit(0)),
        }
    )


def parse_node_info(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Node id, name and version of node-info documents."""
    nodes = F.try_variant_get(doc, "$.nodes", "variant").try_cast(OBJECT)
    rest = [c for c in docs.columns if c != doc]
    rows = docs.select(*rest, F.explode(nodes).alias("node_id", "_v"))
    node = F.col("_v").try_cast(OBJECT)
    return rows.select(
        *rest, "node_id", as_text(node["name"]).alias("node_name"), as_text(node["version"]).alias("version")
    )


def endpoint_candidates(addresses: DataFrame) -> DataFrame:
    """URLs to try per address, plain before secure; IPv6 in brackets."""
    ip = F.when(F.col("ip").contains(":") & ~F.col("ip").startswith("["), F.concat(F.lit("["), "ip", F.lit("]")))
    host = F.coalesce(ip, F.col("ip"))
    rows = addresses.select("*", F.posexplode(F.array(F.lit("http"), F.lit("https"))).alias("attempt", "_scheme"))
    return rows.withColumn("url", F.concat("_scheme", F.lit("://"), host, F.lit(":"), F.col("port").cast("string"))).drop("_scheme")

"""The canonical flow schema and the physical layouts it is read from."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical typed flow table (batch). Streams use TimestampType for ``date`` so watermarks apply.
FLOW_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("ip_source", T.StringType()),
    T.StructField("ip_destination", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("interface_in", T.StringType()),
    T.StructField("interface_out", T.StringType()),
])

FLOW_COLUMNS = [f.name for f in FLOW_SCHEMA.fields]

# L1: 9-column ';' firewall log file, no header.
L1_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("ip_source", T.StringType()),
    T.StructField("ip_destination", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("dest_port", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("interface_in", T.StringType()),
    T.StructField("interface_out", T.StringType()),
])

# L2: 11-column ';' export, no header (firewall_num is dropped after the read).
L2_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("ip_source", T.StringType()),
    T.StructField("ip_destination", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("source_port", T.StringType()),
    T.StructField("dest_port", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("interface_in", T.StringType()),
    T.StructField("interface_out", T.StringType()),
    T.StructField("firewall_num", T.StringType()),
])

# L4 (SQL table) / L5 (JSON lines) share field names.
L45_SCHEMA = T.StructType([
    T.StructField("datetime", T.StringType()),
    T.StructField("ipsrc", T.StringType()),
    T.StructField("ipdst", T.StringType()),
    T.StructField("dstport", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("policyid", T.StringType()),
    T.StructField("interface_in", T.StringType()),
    T.StructField("interface_out", T.StringType()),
])

# Column renames from each layout to canonical names.
LAYOUT_RENAMES = {
    "L1": {},
    "L2": {},
    "L3": {},
    "L4": {"datetime": "date", "ipsrc": "ip_source", "ipdst": "ip_destination", "dstport": "dest_port",
           "proto": "protocol", "policyid": "rule_id"},
    "L5": {"datetime": "date", "ipsrc": "ip_source", "ipdst": "ip_destination", "dstport": "dest_port",
           "proto": "protocol", "policyid": "rule_id"},
    # The ML page's French column names.
    "FR": {"Date": "date", "Adresse_IP_Source": "ip_source", "Adresse_IP_Destination": "ip_destination",
           "Protocole": "protocol", "Port_Destination": "dest_port", "Action": "action",
           "Identifiant_Regle": "rule_id", "Interface_Entree": "interface_in", "Interface_Sortie": "interface_out"},
}

# Rule table used by replay and rate cap.
RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("lo", T.IntegerType()),
    T.StructField("hi", T.IntegerType()),
    T.StructField("not_ports", T.ArrayType(T.IntegerType())),
    T.StructField("src_eq", T.StringType()),
    T.StructField("src_ne", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("per_sec", T.IntegerType()),
])

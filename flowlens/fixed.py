"""Names of the flow record and its label groups, and the matching Spark schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names in file order, nominal columns, label groups ---
BASIC = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent",
]
CONTENT = [
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell",
    "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
]
TRAFFIC = [
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate",
    "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
]
HOST = [
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
TARGET = ["label", "difficulty_level"]
NOMINAL = ["protocol_type", "service", "flag"]
KEY_FEATURES = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "same_srv_rate"]
NORMAL_LABEL = "normal"
ATTACK_GROUPS = {
    "DoS": [
        "back", "land", "neptune", "pod", "smurf", "teardrop", "apache2",
        "udpstorm", "processtable", "mailbomb",
    ],
    "Probe": ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"],
    "R2L": [
        "guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster",
        "warezclient", "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack",
        "httptunnel", "sendmail", "named",
    ],
    "U2R": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps"],
}
# --- end of fixed values ---

FLOW_COLUMNS = BASIC + CONTENT + TRAFFIC + HOST + TARGET
FLOW_CATEGORIES = {"Normal": [NORMAL_LABEL], **ATTACK_GROUPS}
UNKNOWN = "Unknown"
META = "difficulty_level"
TARGETS = ["label", "attack_category", "binary_label"]

_LONG = {"duration", "src_bytes", "dst_bytes"}


def _spark_type(name: str) -> T.DataType:
    if name in NOMINAL or name == "label":
        return T.StringType()
    if name in _LONG:
        return T.LongType()
    return T.DoubleType() if name.endswith("_rate") else T.IntegerType()


FLOW_SCHEMA = T.StructType([T.StructField(c, _spark_type(c)) for c in FLOW_COLUMNS])

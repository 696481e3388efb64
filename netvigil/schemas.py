"""Canonical schemas and fixed vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4

ACTIONS = ["log", "alert", "block", "webhook", "email", "siem"]

# det_seq is any orderable arrival key: layer ordinal first, then row order.
DETECTION_COLUMNS = [
    "capture_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "attack_type", "confidence", "layer", "threat_level", "anomaly_score", "flow_count",
    "ts", "det_seq",
]

EVE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("alert", T.StructType([
        T.StructField("signature_id", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.IntegerType()),
    ])),
])

HOST_ALERT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("rule", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("groups", T.ArrayType(T.StringType())),
    ])),
    T.StructField("agent", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ip", T.StringType()),
    ])),
    T.StructField("data", T.StructType([
        T.StructField("srcip", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dstip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("srcport", T.StringType()),
        T.StructField("dstport", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("srcuser", T.StringType()),
        T.StructField("process_name", T.StringType()),
    ])),
    T.StructField("predecoder", T.StructType([T.StructField("srcip", T.StringType())])),
    T.StructField("syscheck", T.StructType([T.StructField("path", T.StringType())])),
    T.StructField("full_log", T.StringType()),
])

# Canonical (short) feature name -> long header of the public corpus.
FEATURE_HEADERS = {
    "dst_port": "Destination Port",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Total Fwd Packets",
    "tot_bwd_pkts": "Total Backward Packets",
    "totlen_fwd_pkts": "Total Length of Fwd Packets",
    "totlen_bwd_pkts": "Total Length of Bwd Packets",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_tot": "Fwd IAT Total",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "bwd_iat_tot": "Bwd IAT Total",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fwd_header_len": "Fwd Header Length",
    "bwd_header_len": "Bwd Header Length",
    "fwd_pkts_s": "Fwd Packets/s",
    "bwd_pkts_s": "Bwd Packets/s",
    "pkt_len_min": "Min Packet Length",
    "pkt_len_max": "Max Packet Length",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_var": "Packet Length Variance",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "cwe_flag_cnt": "CWE Flag Count",
    "ece_flag_cnt": "ECE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Average Packet Size",
    "fwd_seg_size_avg": "Avg Fwd Segment Size",
    "bwd_seg_size_avg": "Avg Bwd Segment Size",
    "fwd_header_length_2": "Fwd Header Length.1",
    "subflow_fwd_pkts": "Subflow Fwd Packets",
    "subflow_fwd_byts": "Subflow Fwd Bytes",
    "subflow_bwd_pkts": "Subflow Bwd Packets",
    "subflow_bwd_byts": "Subflow Bwd Bytes",
    "init_fwd_win_byts": "Init_Win_bytes_forward",
    "init_bwd_win_byts": "Init_Win_bytes_backward",
    "fwd_act_data_pkts": "act_data_pkt_fwd",
    "fwd_seg_size_min": "min_seg_size_forward",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}

# Further short spellings of the same features.
SHORT_SPELLINGS = {
    "destination_port": "dst_port",
    "min_pkt_len": "pkt_len_min",
    "cwr_flag_cnt": "cwe_flag_cnt",
    "cwr_flag_count": "cwe_flag_cnt",
}

# The anomaly detector's feature list, in model order.
ANOMALY_FEATURES = [
    "dst_port", "pkt_len_min", "bwd_pkt_len_min", "init_fwd_win_byts", "fwd_seg_size_min",
    "bwd_pkt_len_mean", "fwd_pkt_len_min", "bwd_seg_size_avg", "bwd_pkt_len_max", "pkt_len_std",
    "bwd_pkt_len_std", "init_bwd_win_byts", "fwd_header_length_2", "pkt_len_max", "pkt_len_var",
    "pkt_size_avg", "fwd_iat_mean", "subflow_bwd_byts", "flow_iat_max", "fwd_header_len",
]

# The documented classifier feature list.
CLASSIFIER_FEATURES = [
    "flow_duration", "bwd_pkt_len_max", "bwd_pkt_len_mean", "bwd_pkt_len_std", "flow_iat_mean",
    "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_tot", "fwd_iat_mean", "fwd_iat_std",
    "fwd_iat_max", "bwd_iat_tot", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_pkts_s",
    "pkt_len_max", "pkt_len_mean", "pkt_len_std", "pkt_len_var", "fin_flag_cnt", "psh_flag_cnt",
    "ack_flag_cnt", "pkt_size_avg", "bwd_seg_size_avg", "init_fwd_win_byts", "active_mean",
    "active_min", "idle_mean", "idle_std", "idle_max", "idle_min",
]

# Raw label -> attack category. Web-attack labels carry a damaged
# dash in the corpus and are matched by prefix instead (see clean.attack_category).
ATTACK_CATEGORIES = {
    "BENIGN": "BENIGN",
    "DDoS": "DDoS",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS": "DoS",
    "Port Scan": "Port Scan",
    "PortScan": "Port Scan",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Bot": "Bot",
    "Infiltration": "Infiltration",
    "Heartbleed": "Heartbleed",
}
WEB_ATTACK_SUFFIXES = ["Brute Force", "XSS", "Sql Injection"]

"""Packet table -> bidirectional flows with the canonical feature names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions.text import epoch_micros

IDLE_SECONDS, ACTIVE_SECONDS = 120.0, 5.0
# TCP flag bits.
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwe": 128}
KEYS = ["end_a", "end_b", "protocol"]
ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")
PAYLOAD = ("len", "header_len", "flags", "win")


def _stats(name: str, x: Column) -> list[Column]:
    return [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean"),
            F.stddev_samp(x).alias(f"{name}_std")]


def sessionize(
    packets: DataFrame, idle: float = IDLE_SECONDS, active: float = ACTIVE_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Packets with canonical endpoints, direction, session and burst numbers and the gaps before them.

    A session ends after ``idle`` seconds without a packet, a burst after
    ``active``. Rows are exchanged once, by conversation and time slice, so one
    endless conversation still spreads over many tasks. Inside a slice all
    running values are known up to what lies before it: the last packet, the
    last one of each direction, the start of the open burst and the sessions and
    bursts so far. One short row per slice carries these, composed in slice order.
    ``burst_length`` stands at a burst's last packet.
    """
    source = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    target = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    payload = F.struct(
        (source <= target).alias("from_a"), (epoch_micros(F.col("ts")) / F.lit(1e6)).alias("t"),
        *[c for c in packets.columns if c not in (*ENDS, "protocol", "ts", "packet_id")])
    ends = [F.least(source, target).alias("end_a"), F.greatest(source, target).alias("end_b")]
    piece = ["_conversation", "_slice"]
    # Structs as keys, because a null within them equals a null. Both uses below
    # read the whole packet, so that they share one exchange.
    rows = packets.select(
        F.struct(*ends, "protocol").alias("_conversation"),
        F.struct(F.floor(epoch_micros(F.col("ts")) / F.lit(slice_seconds * 1_000_000)).alias("n")).alias("_slice"),
        "ts", "packet_id", payload.alias("p"),
    ).repartition(*piece)

    order = Window.partitionBy(*piece).orderBy("ts", "packet_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    t, gap = F.col("p.t"), F.col("p.t") - F.col("_before")
    local = rows.withColumns({
        "_before": F.lag(t).over(order), "_after": F.lead(t).over(order),
        "_before_a": F.last(F.when(F.col("p.from_a"), t), True).over(earlier),
        "_before_b": F.last(F.when(~F.col("p.from_a"), t), True).over(earlier),
    }).withColumns({
        "_sessions": F.count_if(gap > idle).over(so_far), "_bursts": F.count_if(gap > active).over(so_far),
        "_begun": F.last(F.when(gap > active, t), True).over(so_far),
        "_started": F.last(F.when(gap > idle, t), True).over(so_far),
    })
    summary = local.groupBy(*piece).agg(
        F.min(t).alias("_first"), F.max_by("p", F.struct("ts", "packet_id")).alias("_tail"),
        F.max(F.when(F.col("p.from_a"), t)).alias("_last_a"), F.max(F.when(~F.col("p.from_a"), t)).alias("_last_b"),
        F.max("_sessions").alias("_in_s"), F.max("_bursts").alias("_in_b"), F.max("_begun").alias("_in_begun"),
        F.max("_started").alias("_in_started"))
    slices = Window.partitionBy("_conversation").orderBy("_slice")
    up_to, past = slices.rowsBetween(Window.unboundedPreceding, 0), slices.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.col("_first") - F.col("_c_before")
    carried = summary.withColumns({
        "_c_before": F.lag(F.col("_tail.t")).over(slices), "_c_after": F.lead("_first").over(slices),
        "_c_a": F.last("_last_a", True).over(past), "_c_b": F.last("_last_b", True).over(past),
        "_sessions_before": F.coalesce(F.sum("_in_s").over(past), F.lit(0)),
        "_bursts_before": F.coalesce(F.sum("_in_b").over(past), F.lit(0)),
    }).withColumns({
        "_jump_s": F.count_if(jump > idle).over(up_to), "_jump_b": F.count_if(jump > active).over(up_to),
        "_opens_b": F.when(F.col("_c_before").isNull() | (jump > active), F.col("_first")),
        "_opens_s": F.when(F.col("_c_before").isNull() | (jump > idle), F.col("_first")),
    }).withColumns({
        # Burst and session open at the slice's first packet: begun there, or where an earlier slice last began one.
        "_c_begun": F.coalesce("_opens_b", F.last(F.coalesce("_in_begun", "_opens_b"), True).over(past)),
        "_c_started": F.coalesce("_opens_s", F.last(F.coalesce("_in_started", "_opens_s"), True).over(past)),
        "_c_s": F.col("_sessions_before") + F.col("_jump_s"), "_c_n": F.col("_bursts_before") + F.col("_jump_b"),
    }).select(*piece, "_c_before", "_c_after", "_c_a", "_c_b", "_c_begun", "_c_started", "_c_s", "_c_n")

    before, after = F.coalesce("_before", "_c_before"), F.coalesce("_after", "_c_after")
    same_side = F.when(F.col("p.from_a"), F.coalesce("_before_a", "_c_a")).otherwise(F.coalesce("_before_b", "_c_b"))
    started = F.coalesce("_started", "_c_started")
    return local.join(carried, piece).select(
        "_conversation.*", "ts", "packet_id", "p.*", (F.col("_sessions") + F.col("_c_s")).alias("session"),
        (F.col("_bursts") + F.col("_c_n")).alias("burst"), 
        F.when(t - before <= idle, t - before).alias("iat"), F.when(same_side >= started, t - same_side).alias("dir_iat"),
        F.when(after.isNull() | (after - t > active), t - F.coalesce("_begun", "_c_begun")).alias("burst_length"))


def to_flows(
    packets: DataFrame, idle: float = IDLE_SECONDS, active: float = ACTIVE_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """One row per session. Forward is the direction of the session's first packet.

    Both directions are aggregated by canonical end; the forward/backward names
    are assigned afterwards, which avoids joining the first packet back. A plan has
    one scan and four exchanges: packets, slice summaries there and back, flows.
    """
    needed = packets.select(*ENDS, "protocol", "ts", "packet_id", *PAYLOAD)
    s = sessionize(needed, idle, active, slice_seconds)
    length, first = F.col("len"), F.struct("ts", "packet_id")
    aggs = [
        F.min("ts").alias("ts"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("pkts"),
        F.sum("len").alias("bytes"), F.min_by("from_a", first).alias("a_is_fwd"), F.max("burst").alias("_b1"),
        F.min("burst").alias("_b0"), *_stats("pkt_len", length), F.var_samp(length).alias("pkt_len_var"),
        *_stats("flow_iat", F.col("iat")), *_stats("active", F.col("burst_length")), *_stats("idle", F.when(F.col("iat") > active, F.col("iat"))),
        *[F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0).alias(f"{n}_flag_cnt") for n, bit in FLAGS.items()],
    ]
    for side, here in (("a", F.col("from_a")), ("b", ~F.col("from_a"))):
        size, gap = F.when(here, length), F.when(here, F.col("dir_iat"))
        flag = lambda bit, here=here: F.count_if(here & (F.col("flags").bitwiseAND(F.lit(bit)) != 0))
        aggs += [
            F.count_if(here).alias(f"{side}_pkts"), F.coalesce(F.sum(size), F.lit(0)).alias(f"{side}_bytes"),
            *_stats(f"{side}_pkt_len", size), F.sum(gap).alias(f"{side}_iat_tot"), *_stats(f"{side}_iat", gap),
            F.sum(F.when(here, F.col("header_len"))).alias(f"{side}_header_len"),
            F.min(F.when(here, F.col("header_len"))).alias(f"{side}_seg_size_min"),
            F.min_by(F.when(here, F.col("win")), F.when(here, first)).alias(f"{side}_win"),
            F.count_if(here & (length > F.col("header_len"))).alias(f"{side}_data_pkts"),
            flag(FLAGS["psh"]).alias(f"{side}_psh_flags"), flag(FLAGS["urg"]).alias(f"{side}_urg_flags"),
        ]
    return _name_directions(s.groupBy(*KEYS, "session").agg(*aggs))


def _name_directions(f: DataFrame) -> DataFrame:
    forward = F.col("a_is_fwd")

    def side(direction: str, name: str) -> Column:
        a, b = (f"a_{name}", f"b_{name}") if direction == "fwd" else (f"b_{name}", f"a_{name}")
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    duration = F.col("t1") - F.col("t0")
    rate = lambda n: F.coalesce(F.try_divide(n, duration), F.lit(0.0))
    runs = F.col("_b1") - F.col("_b0") + 1

    def end(first: str, other: str) -> Column:
        return F.when(forward, F.col(first)).otherwise(F.col(other))

    out = {"flow_duration": duration, "flow_byts_s": rate(F.col("bytes")), "flow_pkts_s": rate(F.col("pkts"))}
    for d in ("fwd", "bwd"):
        out |= {
            f"tot_{d}_pkts": side(d, "pkts"), f"totlen_{d}_pkts": side(d, "bytes"),
            **{f"{d}_pkt_len_{k}": side(d, f"pkt_len_{k}") for k in ("max", "min", "mean", "std")},
            **{f"{d}_iat_{k}": side(d, f"iat_{k}") for k in ("tot", "mean", "std", "max", "min")},
            f"{d}_psh_flags": side(d, "psh_flags"), f"{d}_urg_flags": side(d, "urg_flags"),
            f"{d}_header_len": side(d, "header_len"), f"{d}_pkts_s": rate(side(d, "pkts")),
            f"{d}_seg_size_avg": side(d, "pkt_len_mean"), f"init_{d}_win_byts": side(d, "win"),
            f"subflow_{d}_pkts": side(d, "pkts") / runs, f"subflow_{d}_byts": side(d, "bytes") / runs,
        }
    out |= {
        "down_up_ratio": F.coalesce(F.try_divide(side("bwd", "pkts"), side("fwd", "pkts")), F.lit(0.0)),
        "pkt_size_avg": F.col("bytes") / F.col("pkts"), "fwd_act_data_pkts": side("fwd", "data_pkts"),
        "fwd_seg_size_min": side("fwd", "seg_size_min"), "fwd_header_length_2": side("fwd", "header_len"),
    }
    same = ["pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std", "pkt_len_var", "flow_iat_mean",
            "flow_iat_std", "flow_iat_max", "flow_iat_min", "active_mean", "active_std", "active_max", "active_min",
            "idle_mean", "idle_std", "idle_max", "idle_min", *[f"{n}_flag_cnt" for n in FLAGS]]
    return f.select(
        end("end_a.ip", "end_b.ip").alias("src_ip"), end("end_b.ip", "end_a.ip").alias("dst_ip"),
        end("end_a.port", "end_b.port").alias("src_port"), end("end_b.port", "end_a.port").alias("dst_port"),
        "protocol", "session", "ts", *[v.alias(k) for k, v in out.items()], *same,
    )

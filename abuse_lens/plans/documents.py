"""The four documents of a run as ordered lines.

A document is a DataFrame of ``value`` lines and order columns.  Written with
:func:`write`, Spark range-sorts the lines into part files whose concatenation
is the document: however many rules or sources it has, no single task and not
the driver holds it.  Only bounded facts (one summary row, the top offenders,
the last key of a list) are collected.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from abuse_lens.config import FP_LIMIT_PCT, REPORT_VERSION, RULES_VERSION
from abuse_lens.operators import decisions as dec
from abuse_lens.operators.episodes import trigger_reason
from abuse_lens.plans.report import Report
from abuse_lens.plans.settle import settle
from abuse_lens.sources.allowlist import exceptions

# The wording, indentation and number formats below are fixed values of the
# documents: readers compare them byte by byte.
ORDER = ["part", "n1", "t1", "t2", "n2", "n3"]


def json_float(x: float) -> str:
    """Shortest decimal of a double, plain from 1e-5 up to 1e16, else with ``e``."""
    text = repr(abs(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, tail = mantissa.partition(".")
    digits = (whole + tail).lstrip("0")
    point = len(whole) + int(exponent or 0)
    point -= len(whole + tail) - len((whole + tail).lstrip("0"))
    digits = digits.rstrip("0")
    sign = "-" if str(x).startswith("-") else ""
    if not digits:
        return sign + "0.0"
    if 0 < point <= 16:
        return sign + digits[:point].ljust(point, "0") + "." + (digits[point:] or "0")
    if -5 < point <= 0:
        return sign + "0." + "0" * -point + digits
    rest = "." + digits[1:] if digits[1:] else ""
    return f"{sign}{digits[0]}{rest}e{point - 1}"


@F.pandas_udf(StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(json_float, na_action="ignore")


def _lines(spark: SparkSession, part: int, lines: list[str]) -> DataFrame:
    """Fixed lines of a section, in the given order."""
    texts = F.array(*[F.lit(line) for line in lines])
    rows = spark.range(0, 1, 1, 1).select(F.posexplode(texts).alias("at", "value"))
    return _ordered(rows, F.col("value"), part, n1=F.col("at"))


def _ordered(df: DataFrame, value: Column, part, n1=None, t1=None, t2=None, n2=None, n3=None) -> DataFrame:
    number = lambda c: (F.lit(0) if c is None else c).cast("bigint")
    text = lambda c: F.lit("") if c is None else c
    return df.select(
        F.lit(part).cast("int").alias("part"), number(n1).alias("n1"), text(t1).alias("t1"), text(t2).alias("t2"),
        number(n2).alias("n2"), number(n3).alias("n3"), value.alias("value"),
    )


def _port(column: str = "dst_port") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-1).cast("bigint"))


def _object(indent: int, fields: list[tuple[str, Column | list]]) -> Column:
    """Pretty-printed JSON object; a list value is a nested object."""
    pad = " " * indent

    def body(fields, pad) -> list[Column]:
        out: list[Column] = []
        for i, (name, value) in enumerate(fields):
            comma = "" if i == len(fields) - 1 else ","
            start = f'{pad}  "{name}": '
            if isinstance(value, list):
                out += [F.lit(start + "{\n"), *body(value, pad + "  "), F.lit(f"{pad}  }}{comma}\n")]
            else:
                out += [F.lit(start), F.coalesce(value, F.lit("null")), F.lit(f"{comma}\n")]
        return out

    return F.concat(F.lit(pad + "{\n"), *body(fields, pad), F.lit(pad + "}"))


def _quoted(value: Column | str) -> Column:
    column = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit('"'), column, F.lit('"'))


def _text(value: Column) -> Column:
    return value.cast("string")


def _array(spark, part: int, name: str, items: DataFrame, pad: str, comma: str) -> DataFrame:
    """A JSON array whose elements are the ``value`` of ordered ``items`` (all in part + 1)."""
    key = F.struct(*ORDER)
    last = items.agg(F.max(key).alias("k")).first()["k"]
    if last is None:
        return _lines(spark, part, [f'{pad}"{name}": []{comma}'])
    is_last = F.lit(True)
    for column in ORDER:
        is_last = is_last & (F.col(column) == F.lit(last[column]))
    separated = items.withColumn("value", F.when(is_last, F.col("value")).otherwise(F.concat("value", F.lit(","))))
    opening = _lines(spark, part, [f'{pad}"{name}": ['])
    return opening.union(separated).union(_lines(spark, part + 2, [f"{pad}]{comma}"]))


def _int_array(name: str, values, pad: str, comma: str) -> list[str]:
    if not values:
        return [f'{pad}"{name}": []{comma}']
    inner = [f"{pad}  {v}{',' if i < len(values) - 1 else ''}" for i, v in enumerate(values)]
    return [f'{pad}"{name}": [', *inner, f"{pad}]{comma}"]


def rules_lines(r: Report, part: int = 0) -> DataFrame:
    """The rules document; uses parts ``part`` to ``part + 9``."""
    spark = r.rules.sparkSession
    c = F.col
    head = [
        "{",
        f'  "version": {RULES_VERSION},',
        f'  "generated_at": {r.now},',
        '  "match_criteria": {',
        '    "proto": "tcp",',
        *_int_array("dst_ports", list(r.cfg.dst_ports), "    ", ""),
        "  },",
    ]
    trigger = _object(
        4,
        [
            ("key_type", _quoted(c("key_type"))),
            ("key_value", _quoted(c("key_value"))),
            ("dst_port", _text(c("dst_port"))),
            ("abuse_class", _quoted(c("abuse_class"))),
            ("window_sec", _text(c("window_sec"))),
            ("syn_rate_threshold", F.lit(json_float(float(r.cfg.syn_rate_threshold)))),
            ("success_ratio_threshold", F.lit(json_float(float(r.cfg.success_ratio_threshold)))),
            ("action", [("action_type", _quoted(c("action_type"))), ("duration_sec", _text(c("duration_sec")))]),
        ],
    )
    triggers = _ordered(r.rules, trigger, part + 2, t1=c("key_type"), t2=c("key_value"), n2=_port())
    listed = exceptions(r.allow)
    exception = _object(4, [("key_type", _quoted(c("key_type"))), ("key_value", _quoted(c("key_value")))])
    excepted = _ordered(listed, exception, part + 5, n1=c("rank"), n2=c("network"), n3=c("prefix_len"))
    return (
        _lines(spark, part, head)
        .union(_array(spark, part + 1, "triggers", triggers, "  ", ","))
        .union(_array(spark, part + 4, "exceptions", excepted, "  ", ""))
        .union(_lines(spark, part + 8, ["}"]))
    )


def evidence_lines(r: Report) -> DataFrame:
    return evidence_of(r.decisions)


def evidence_of(decisions: DataFrame) -> DataFrame:
    """The evidence document of a table of decisions."""
    spark = decisions.sparkSession
    columns = ["source", "abuse_class", "syn_rate", "success_ratio", "decision", "packets", "bytes", "syn"]
    rows = dec.evidence(decisions)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    body = _ordered(rows, line, 1, n1=F.col("key_ord"), n2=F.col("ip_u32"), n3=_port())
    return _lines(spark, 0, [",".join(columns)]).union(body)


def _fp_lines(r: Report) -> list[str]:
    if not r.impact["fp_computed"]:
        return [
            "- **FP bound**: UNKNOWN",
            f"- **Reason**: {r.impact['fp_reason']}",
            "- Enforcement decision should be made with caution.",
        ]
    fp = r.impact["fp_value_pct"]
    if fp == 0.0:
        note = "- No likely legitimate traffic would be blocked."
    elif fp <= FP_LIMIT_PCT:
        note = "- FP bound is within acceptable range (<= 5%)."
    else:
        note = "- **WARNING**: FP bound exceeds acceptable threshold (> 5%)."
    return [f"- **FP bound**: {fp:.1f}%", note]


def report_lines(r: Report) -> DataFrame:
    """The Markdown report in five sections."""
    spark = r.decisions.sparkSession
    cfg, h, i = r.cfg, r.header, r.impact
    listed = r.allow.ip_count or r.allow.cidr_count
    allow_text = f"{r.allow.ip_count} IPs, {r.allow.cidr_count} CIDRs" if listed else "None configured"
    top = [
        f"# {cfg.report_title}", "",
        "## 1. Scope & Configuration", "",
        f"- **Time window start**: {h['start_ts']}",
        f"- **Time window end**: {h['end_ts']}",
        f"- **Duration**: {h['duration_sec']} seconds",
        f"- **Destination ports**: {', '.join(str(p) for p in cfg.dst_ports)}",
        f"- **Window size**: {cfg.window_sec} seconds",
        f"- **SYN rate threshold**: {cfg.syn_rate_threshold:.1f} SYN/sec",
        f"- **Success ratio threshold**: {cfg.success_ratio_threshold:.2f}",
        f"- **Block duration**: {cfg.block_duration_sec} seconds",
        f"- **Allowlist**: {allow_text}", "",
        "## 2. Abuse Pattern Observed", "",
    ]
    if r.offenders:
        top += [
            f"Detected {len(r.offenders)} source(s) matching abuse pattern (TCP SYN churn).", "",
            "### Top Offenders", "",
            "| Source | SYN Rate | Success Ratio | Would Block Packets | Would Block SYN |",
            "|--------|----------|---------------|---------------------|------------------|",
        ]
        for o in r.offenders:
            cells = (
                o["source"],
                f"{o['shown_syn_rate']:.1f}/sec",
                f"{o['shown_success_ratio']:.2f}",
                str(o["would_block_packets"]),
                str(o["would_block_syn"]),
            )
            top.append("| " + " | ".join(cells) + " |")
    else:
        top.append("No abuse pattern detected matching the trigger conditions.")
    if i["total_packets"]:
        basis = f"- Analysis based on {i['total_packets']} total packets, {i['total_syn']} total SYN."
    else:
        basis = "- No traffic was observed during the analysis window."
    top += [
        "",
        "## 3. Counterfactual Enforcement Impact", "",
        "### Blocked Traffic (if rules were enforced)", "",
        f"- **Packets blocked**: {i['percent_packets_blocked']:.1f}%",
        f"- **Bytes blocked**: {i['percent_bytes_blocked']:.1f}%",
        f"- **SYN blocked**: {i['percent_syn_blocked']:.1f}%", "",
        "### False Positive Bound", "",
        *_fp_lines(r), "",
        "### Uncertainty", "",
        basis, "",
        "## 4. Candidate Enforcement Rules", "",
        "```json",
    ]
    if i["is_safe"]:
        verdict = [
            "**This abuse class IS safe for autonomous enforcement.**", "",
            "All safety criteria have been met:",
            "- Abuse pattern clearly detected",
            "- False positive bound within acceptable limits",
            "- Meaningful impact on malicious traffic",
        ]
    else:
        verdict = [
            "**This abuse class IS NOT safe for autonomous enforcement.**", "",
            "Gating reasons:", "",
            *[f"- {reason}" for reason in i["reasons"]],
        ]
    tail = ["```", "", "## 5. Readiness Judgment", "", *verdict, ""]
    return _lines(spark, 0, top).union(rules_lines(r, 10)).union(_lines(spark, 30, tail))


def summary_lines(r: Report) -> DataFrame:
    """The machine-readable summary."""
    spark = r.decisions.sparkSession
    c, cfg, h, i = F.col, r.cfg, r.header, r.impact
    fl = lambda name: _float_text(c(name))
    head = [
        "{",
        f'  "report_version": {REPORT_VERSION},',
        f'  "run_id": {h["run_id"]},',
        f'  "input_schema_version_min": {h["version_min"]},',
        f'  "input_schema_version_max": {h["version_max"]},',
        '  "time_range": {',
        f'    "start_ts": {h["start_ts"]},',
        f'    "end_ts": {h["end_ts"]},',
        f'    "duration_sec": {h["duration_sec"]}',
        "  },",
        *_int_array("ports_analyzed", sorted(cfg.dst_ports), "  ", ","),
        '  "config": {',
        f'    "window_sec": {cfg.window_sec},',
        f'    "syn_rate_threshold": {json_float(float(cfg.syn_rate_threshold))},',
        f'    "success_ratio_threshold": {json_float(float(cfg.success_ratio_threshold))},',
        f'    "block_duration_sec": {cfg.block_duration_sec},',
        f'    "vol_syn_rate": {json_float(float(cfg.vol_syn_rate))},',
        f'    "vol_pkt_rate": {json_float(float(cfg.vol_pkt_rate))},',
        f'    "vol_byte_rate": {json_float(float(cfg.vol_byte_rate))}',
        "  },",
    ]
    trigger = _object(
        4,
        [
            ("abuse_class", _quoted(c("abuse_class"))),
            ("src", _quoted(c("src_ip"))),
            ("dst_port", _text(c("dst_port"))),
            (
                "rates",
                [
                    ("syn_rate", fl("max_syn_rate")),
                    ("pkt_rate", fl("max_pkt_rate")),
                    ("byte_rate", fl("max_byte_rate")),
                    ("success_ratio", fl("min_success_ratio")),
                ],
            ),
            ("confidence", _quoted("high")),
        ],
    )
    triggered = r.episodes.where(c("abuse_class").isNotNull())
    triggers = _ordered(
        triggered, trigger, 2, t1=c("abuse_class"), t2=c("src_ip"), n2=_port(), n3=c("start_ts") * 2 + c("key_ord")
    )
    episode = _object(
        4,
        [
            ("src_ip", _quoted(c("src_ip"))),
            ("dst_port", _text(c("dst_port"))),
            *[(n, _text(c(n))) for n in ("start_ts", "end_ts", "duration_sec", "interval_count", "interval_sec")],
            ("episode_type", _quoted(c("episode_type"))),
            *[(n, fl(n)) for n in ("max_syn_rate", "max_pkt_rate", "max_byte_rate")],
            ("abuse_class", _quoted(F.coalesce("abuse_class", F.lit("")))),
            ("trigger_reason", _quoted(trigger_reason(cfg))),
        ],
    )
    listed = _ordered(r.episodes, episode, 5, n1=c("start_ts"), t1=c("src_ip"), n2=_port(), n3=c("key_ord"))
    fp = i["fp_value_pct"]
    reasons = [json.dumps(x, ensure_ascii=False) for x in r.enforcement_reasons]
    tail = [
        '  "blocked_traffic": {',
        f'    "packets_blocked_pct": {json_float(i["percent_packets_blocked"])},',
        f'    "bytes_blocked_pct": {json_float(i["percent_bytes_blocked"])},',
        f'    "syn_blocked_pct": {json_float(i["percent_syn_blocked"])},',
        f'    "packets_blocked_count": {i["blocked_packets"]},',
        f'    "bytes_blocked_count": {i["blocked_bytes"]},',
        f'    "syn_blocked_count": {i["blocked_syn"]}',
        "  },",
        '  "fp_bound": {',
        f'    "computed": {json.dumps(i["fp_computed"])},',
        f'    "value_pct": {"null" if fp is None else json_float(fp)},',
        f'    "reason": {json.dumps(i["fp_reason"])}',
        "  },",
        f'  "enforcement_safe": {json.dumps(not reasons)},',
        *_int_array("enforcement_reasons", reasons, "  ", ""),
        "}",
    ]
    return (
        _lines(spark, 0, head)
        .union(_array(spark, 1, "triggers", triggers, "  ", ","))
        .union(_array(spark, 4, "episodes", listed, "  ", ","))
        .union(_lines(spark, 8, tail))
    )


def numbered(lines: DataFrame) -> DataFrame:
    """A document line by line, with ``line_no`` from 1.

    Spark range-sorts the lines; each partition numbers its own, and what the partitions
    before it hold is summed over one row a partition.  So no task sees the whole document.
    The sorted lines are written first: a second sort could draw other borders.
    """
    c = F.col
    place = F.monotonically_increasing_id()  # partition, then row within it in the low 33 bits
    elements = lines.orderBy(*ORDER, "value")  # cut into lines when they are in order, so equal ones keep together
    cut = elements.select(F.explode(F.split("value", "\n")).alias("value"))
    placed = settle(cut.select(place.alias("_place"), "value")).withColumn("_partition", F.shiftright("_place", 33))
    counts = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    row = c("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_partition").select((c("_before") + row + 1).alias("line_no"), "value")


def write(lines: DataFrame, path: str) -> None:
    """Write a document as ordered text parts under ``path``."""
    lines.orderBy(*ORDER).select("value").write.mode("overwrite").text(path)


def write_all(r: Report, out_dir: str) -> None:
    """rules.json, report.md, evidence.csv and summary.json, each a folder of ordered parts."""
    write(rules_lines(r), f"{out_dir}/rules.json")
    write(report_lines(r), f"{out_dir}/report.md")
    write(evidence_lines(r), f"{out_dir}/evidence.csv")
    write(summary_lines(r), f"{out_dir}/summary.json")

"""End-to-end scenarios: snapshot lines in, documents out, compared byte by byte."""

import json

import pytest
from abuse_lens.config import ReportConfig
from abuse_lens.plans import documents, report
from abuse_lens.sources import allowlist, snapshots
from helpers import bucket, lines, read_document, snapshot

CFG = ReportConfig(
    dst_ports=(8080,), window_sec=10, min_samples_for_fp=1, first_appearance="raw", report_title="Title"
)
ATTACKER = bucket("10.0.0.1", 5000, 50, 10, 0, 5050, 505000)
EDGE = [
    bucket("10.0.0.1", 1000, 100, 100, 0, 1100, 110000),
    bucket("10.0.0.2", 999, 50, 50, 0, 1049, 104900),
    bucket("10.0.0.3", 1500, 165, 165, 0, 1665, 166500),
]
HEADER = "source,abuse_class,syn_rate,success_ratio,decision,packets,bytes,syn\n"
FLOOD_LINE = "10.0.0.1:8080,SYN_FLOOD_LIKE,500.00,0.0020,block,5050,505000,5000\n"
SCENARIOS = {
    "syn_churn": ([ATTACKER], CFG, [], 1000, HEADER + FLOOD_LINE, ["10.0.0.1"]),
    "legitimate": (
        [bucket("10.0.0.2", 100, 90, 90, 5, 200, 20000)], CFG, [], 1000,
        HEADER + "10.0.0.2:8080,,10.00,0.9000,allow,200,20000,100\n", [],
    ),
    "allowlisted": (
        [ATTACKER], CFG, ["# Allowlist for testing", "10.0.0.1"], 1000,
        HEADER + "10.0.0.1:8080,,500.00,0.0020,allow,5050,505000,5000\n", [],
    ),
    "fp_unknown": ([ATTACKER], CFG.with_(min_samples_for_fp=10), [], 1000, HEADER + FLOOD_LINE, ["10.0.0.1"]),
    "boundary": (
        EDGE, CFG, [], 1005,
        HEADER + "10.0.0.1:8080,SYN_FLOOD_LIKE,100.00,0.1000,block,1100,110000,1000\n"
        "10.0.0.2:8080,,99.90,0.0501,allow,1049,104900,999\n10.0.0.3:8080,,150.00,0.1100,allow,1665,166500,1500\n",
        ["10.0.0.1"],
    ),
}


def run(spark, buckets, cfg, allow_lines, now, extra=()):
    text = lines(spark, [snapshot(1000, buckets, version=5), *extra])
    allow = allowlist.from_lines(spark, allow_lines) if allow_lines else allowlist.empty(spark)
    return report.build(snapshots.parse(text).good, cfg, allow, now)


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, tmp_path, name):
    buckets, cfg, allow_lines, now, evidence, sources = SCENARIOS[name]
    r = run(spark, buckets, cfg, allow_lines, now)
    documents.write_all(r, str(tmp_path))
    assert read_document(tmp_path / "evidence.csv") == evidence
    text = read_document(tmp_path / "rules.json")
    exceptions = [{"key_type": "src_ip", "key_value": "10.0.0.1"}] if allow_lines else []
    expected = {
        "version": 3,
        "generated_at": now,
        "match_criteria": {"proto": "tcp", "dst_ports": [8080]},
        "triggers": [
            {
                "key_type": "src_ip", "key_value": s, "dst_port": 8080, "abuse_class": "SYN_FLOOD_LIKE", "window_sec": 10,
                "syn_rate_threshold": 100.0, "success_ratio_threshold": 0.1,
                "action": {"action_type": "drop", "duration_sec": 300},
            }
            for s in sources
        ],
        "exceptions": exceptions,
    }
    assert text == json.dumps(expected, indent=2) + "\n"
    md = read_document(tmp_path / "report.md")
    assert text in md
    summary = json.loads(read_document(tmp_path / "summary.json"))
    flagged = ["10.0.0.1"] if name == "allowlisted" else sources  # episodes are listed whoever they are from
    assert [t["src"] for t in summary["triggers"]] == flagged
    assert read_document(tmp_path / "summary.json") == json.dumps(summary, indent=2) + "\n"


def test_boundary_report_text(spark, tmp_path):
    buckets, cfg, allow_lines, now, _, _ = SCENARIOS["boundary"]
    r = run(spark, buckets, cfg, allow_lines, now)
    documents.write(documents.report_lines(r), str(tmp_path / "r"))
    md = read_document(tmp_path / "r")
    before, _, after = md.partition("## 4. Candidate Enforcement Rules\n\n```json\n")
    assert before == (
        "# Title\n\n## 1. Scope & Configuration\n\n"
        "- **Time window start**: 1000\n- **Time window end**: 1000\n- **Duration**: 0 seconds\n"
        "- **Destination ports**: 8080\n- **Window size**: 10 seconds\n- **SYN rate threshold**: 100.0 SYN/sec\n"
        "- **Success ratio threshold**: 0.10\n- **Block duration**: 300 seconds\n- **Allowlist**: None configured\n\n"
        "## 2. Abuse Pattern Observed\n\nDetected 1 source(s) matching abuse pattern (TCP SYN churn).\n\n"
        "### Top Offenders\n\n| Source | SYN Rate | Success Ratio | Would Block Packets | Would Block SYN |\n"
        "|--------|----------|---------------|---------------------|------------------|\n"
        "| 10.0.0.1:8080 | 100.0/sec | 0.10 | 1100 | 1000 |\n\n"
        "## 3. Counterfactual Enforcement Impact\n\n### Blocked Traffic (if rules were enforced)\n\n"
        "- **Packets blocked**: 28.8%\n- **Bytes blocked**: 28.8%\n- **SYN blocked**: 28.6%\n\n"
        "### False Positive Bound\n\n- **FP bound**: 0.0%\n- No likely legitimate traffic would be blocked.\n\n"
        "### Uncertainty\n\n- Analysis based on 3814 total packets, 3499 total SYN.\n\n"
    )
    assert after.partition("```\n")[2] == (
        "\n## 5. Readiness Judgment\n\n**This abuse class IS safe for autonomous enforcement.**\n\n"
        "All safety criteria have been met:\n- Abuse pattern clearly detected\n"
        "- False positive bound within acceptable limits\n- Meaningful impact on malicious traffic\n\n"
    )


def test_unknown_bound_report_text(spark, tmp_path):
    buckets, cfg, allow_lines, now, _, _ = SCENARIOS["allowlisted"]
    r = run(spark, buckets, cfg, allow_lines, now)
    documents.write(documents.report_lines(r), str(tmp_path / "r"))
    md = read_document(tmp_path / "r")
    assert "- **Allowlist**: 1 IPs, 0 CIDRs\n\n" in md
    assert "No abuse pattern detected matching the trigger conditions.\n\n## 3." in md
    assert (
        "- **FP bound**: UNKNOWN\n- **Reason**: Insufficient data: 0 keys, need at least 1\n"
        "- Enforcement decision should be made with caution.\n\n### Uncertainty\n\n"
        "- No traffic was observed during the analysis window.\n\n"
    ) in md
    assert md.endswith(
        "**This abuse class IS NOT safe for autonomous enforcement.**\n\nGating reasons:\n\n"
        "- False positive bound unknown: Insufficient data: 0 keys, need at least 1\n"
        "- No abuse pattern detected\n- No traffic observed\n\n"
    )


def test_single_snapshot_gives_no_decisions_in_baseline_mode(spark):
    r = run(spark, [ATTACKER], CFG.with_(first_appearance="baseline"), [], 1000)
    assert r.decisions.count() == 0
    assert r.rules.count() == 1  # the first snapshot's interval still forms an episode
    assert r.impact["reasons"][0].startswith("False positive bound unknown")


def test_multi_interval_run(spark, tmp_path):
    """Deltas over three snapshots: one long episode, safe report, ports from the data."""
    def at(ts, n):
        return snapshot(ts, [bucket("10.0.0.1", 10000 * n, 0, 10 * n, 0, 20000 * n, 1000000 * n), bucket("10.0.0.9", 10 * n, 9 * n, 9 * n, 0, 50 * n, 5000 * n, port=None)])

    text = lines(spark, [at(1060, 1), at(1120, 2), at(1180, 3)])
    cfg = CFG.with_(dst_ports=(), first_appearance="baseline")
    r = report.build(snapshots.parse(text).good, cfg, allowlist.empty(spark), 2000)
    assert r.cfg.dst_ports == (8080,)
    ep = [e.asDict() for e in r.episodes.collect()]
    assert [(e["src_ip"], e["start_ts"], e["end_ts"], e["duration_sec"], e["interval_count"]) for e in ep] == [
        ("10.0.0.1", 1120, 1180, 120, 2)
    ]
    assert r.enforcement_reasons == []
    documents.write_all(r, str(tmp_path))
    summary = json.loads(read_document(tmp_path / "summary.json"))
    assert summary["enforcement_safe"] is True
    assert summary["episodes"][0]["max_syn_rate"] == 10000 / 60
    assert summary["time_range"] == {"start_ts": 1060, "end_ts": 1180, "duration_sec": 120}
    evidence = read_document(tmp_path / "evidence.csv").splitlines()
    assert evidence[1].startswith("10.0.0.1:8080,SYN_FLOOD_LIKE,2000.00,0.0010,block")
    assert evidence[2] == "10.0.0.9,,2.00,0.9000,allow,100,10000,20"


def test_same_documents_for_any_partitioning(spark, tmp_path):
    buckets = [bucket(f"10.0.{i}.7", 1000 + i, 1, i % 200, 0, 2000, 10**6) for i in range(40)]
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        r = run(spark, buckets, CFG, ["10.0.8.0/22"], 5)
        documents.write_all(r, str(tmp_path / n))
        seen.append([read_document(tmp_path / n / d) for d in ("rules.json", "report.md", "evidence.csv", "summary.json")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


@pytest.mark.parametrize(
    "value, text",
    [(100.0, "100.0"), (0.1, "0.1"), (1e6, "1000000.0"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (0.0, "0.0"),
     (1.5e-5, "0.000015"), (1e-7, "1e-7"), (1.25e-9, "1.25e-9"), (1.2345e20, "1.2345e20"), (12345678.9, "12345678.9"),
     (1 / 3, "0.3333333333333333"), (-2.5, "-2.5")],
)
def test_json_float(value, text):
    assert documents.json_float(value) == text


def test_numbered_lines_over_many_partitions(spark):
    """Elements of several lines keep together, equal elements are all kept, an empty document has no lines."""
    from pyspark.sql import functions as F

    from abuse_lens.operators.compare import first_difference

    rows = spark.range(0, 3000, 1, 16).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("n"))
    text = F.concat(F.lit("{\n  "), F.col("n").cast("string"), F.lit("\n}"))
    document = documents._ordered(rows, text, 1, n1=F.col("n"))
    got = {r.line_no: r.value for r in documents.numbered(document).collect()}
    want = [line for n in sorted(r.n for r in rows.collect()) for line in ("{", f"  {n}", "}")]
    assert [got[i + 1] for i in range(len(got))] == want
    assert documents.numbered(document.limit(0)).isEmpty()

    longer = documents.numbered(document.union(documents._ordered(spark.range(1), F.lit("end"), 2)))
    assert [tuple(r) for r in first_difference(documents.numbered(document), longer).collect()] == [(9001, None, "end")]
    other = documents.numbered(document.withColumn("value", F.regexp_replace("value", "^\\{\n  500\n", "{\n  501\n")))
    assert [tuple(r) for r in first_difference(documents.numbered(document), other).collect()] == [(4502, "  500", "  501")]

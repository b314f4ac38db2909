"""Small hand-made cases: ties, equal gaps, empty inputs, and the published smoke numbers."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup, net, roles
from tidemark.operators import components, metrics, ordered, replay, windows
from tidemark.sources import documents, pcap

PACKET = "event_id long, capture_id long, ts double, length int, role string, direction string, flow_id string, payload_len int, proto string"


def packets(spark, rows):
    return spark.createDataFrame([(i, c, float(t), 100, "view", "up", f"{c}:0", 100, "TCP") for i, (c, t) in enumerate(rows)], PACKET)


def test_equal_gap_stays_in_the_burst(spark):
    got = ordered.bursts(packets(spark, [(1, 0), (1, 5), (1, 10.5)]), 5.0).orderBy("burst_no").collect()
    assert [(r.start, r["end"], r.n_pkts) for r in got] == [(0, 5, 2), (10.5, 10.5, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], PACKET)
    assert ordered.bursts(none, 1.0).count() == 0
    assert windows.fixed_windows(windows.anchors_at_start(none), [1.0]).count() == 0
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_are_closed_and_clipped(spark):
    p = packets(spark, [(1, 0), (1, 10), (1, 11)])
    w = windows.fixed_windows(windows.anchors_at_start(p), [10.0, 99.0])
    got = {r.window_name: (r.n_pkts, r.duration) for r in windows.base_features(p, w).collect()}
    assert got == {"w10": (2, 10.0), "w99": (3, 11.0)}


def test_suppression_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.randrange(50), float(rng.randrange(8))) for c in range(5) for i in range(30)]
    df = spark.createDataFrame([(c, i, float(t), s) for c, i, t, s in rows], "capture_id long, event_id long, ts double, score double")
    got = {(r.capture_id, r["rank"]): r.event_id for r in ordered.suppress_near(df, 4.0, 6).collect()}
    want = {}
    for c in range(5):
        kept = []
        for _, i, t, _ in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[3], r[2], r[1])):
            if len(kept) < 6 and all(abs(t - x) > 4 for x, _ in kept):
                kept.append((t, i))
        want |= {(c, k + 1): i for k, (_, i) in enumerate(kept)}
    assert got == want


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


SCORES = {"m425": [.95, .93, .91, .89, .87, .60, .40, .30, .20, .10], "m228": [.95, .86, .82, .70, .65, .60, .58, .40, .20, .10]}


@pytest.mark.parametrize("name, threshold, counts, f1, fpr, wf1, wfpr", [("m425", 0.5, (5, 1, 4, 0), 90.91, 20.0, 95.24, 12.5), ("m228", 0.75, (3, 0, 5, 2), 75.0, 0.0, 75.0, 0.0)])
def test_published_smoke_numbers(spark, name, threshold, counts, f1, fpr, wf1, wfpr):
    ids = [f"p{i}" for i in range(1, 6)] + [f"b{i}" for i in range(1, 6)]
    rows = spark.createDataFrame([(i, "phishing" if i[0] == "p" else "benign", s) for i, s in zip(ids, SCORES[name])], "sample_id string, label string, prob_1 double")
    p = metrics.canonical_predictions(rows)
    w = spark.createDataFrame([(i, 0.5 if i in ("b1", "b2") else 1.0) for i in ids], "id string, weight double")
    plain, heavy = metrics.binary_metrics(p, threshold).first(), metrics.binary_metrics(metrics.with_weights(p, w), threshold).first()
    assert (plain.tp, plain.fp, plain.tn, plain.fn) == counts
    assert (round(100 * plain.f1, 2), round(100 * plain.fpr, 2)) == (f1, fpr)
    if name == "m425":
        assert (round(100 * heavy.f1, 2), round(100 * heavy.fpr, 2)) == (wf1, wfpr)
    assert metrics.average_precision(p).first()[0] == pytest.approx(1.0)
    assert metrics.recall_at_fpr(p, 0.03).first().recall == 1.0


def test_unknown_label_and_missing_weight_fail(spark):
    with pytest.raises(Exception, match="unknown label"):
        metrics.canonical_predictions(spark.createDataFrame([("a", "maybe", 0.1)], "capture_id string, y string, score double")).collect()
    p = metrics.canonical_predictions(spark.createDataFrame([("a", "1", 0.1)], "capture_id string, y string, score double"))
    with pytest.raises(Exception, match="no single weight"):
        metrics.with_weights(p, spark.createDataFrame([], "id string, weight double")).collect()


def test_hosts(spark):
    rows = [(" WWW.Example.COM:443", "example.com"), ("a.b.vercel.app", "b.vercel.app"), ("api.infura.io", "x.com"), (None, "x.com"), ("bit.ly", "bit.ly"), ("s3-eu.amazonaws.com", "q.net"), ("shop.q.net", "www.q.net")]
    df = spark.createDataFrame(rows, "h string, p string").select(net.normalize_host(F.col("h")).alias("n"), net.registrable_domain(F.col("h")).alias("d"), roles.classify_host(F.col("h"), F.col("p")).alias("r"))
    assert [tuple(r) for r in df.collect()] == [
        ("www.example.com", "example.com", "first_party_site"), ("a.b.vercel.app", "a.b.vercel.app", "first_party_site"), ("api.infura.io", "infura.io", "rpc_provider"), ("", "", "unknown"),
        ("bit.ly", "bit.ly", "url_shortener"), ("s3-eu.amazonaws.com", "amazonaws.com", "object_storage"), ("shop.q.net", "q.net", "first_party_site")]
    masked = spark.createDataFrame([("/A/12/1234//x/",), ("",), ("/0x" + "a" * 40,)], "p string").select(net.mask_path(F.col("p")))
    assert [r[0] for r in masked.collect()] == ["/a/{n}/{num}/x", "/", "/{addr}"]
    assert spark.range(1).select(roles.best_role(F.array(F.lit("unknown"), F.lit("url_shortener"), F.lit("analytics_ads")))).first()[0] == "url_shortener"


def test_markup(spark):
    html = "<html><title> Hi &amp; bye</title><script src='/a.js'></script><script>var x = 12; // c\n</script><style>p{}</style><p class='a'>See https://x.y 12,5</p></html>"
    r = spark.createDataFrame([(html,)], "h string").select(markup.title(F.col("h")).alias("t"), markup.script_sources(F.col("h")).alias("s"), markup.visible_text(F.col("h")).alias("v"), F.transform(markup.inline_scripts(F.col("h")), markup.normalize_script).alias("i")).first()
    assert (r.t, r.s, r.v, r.i) == ("Hi &amp; bye", ["/a.js"], "hi bye see url num", ["var x = NUM ;"])


def test_boundaries_measure_from_the_first_kept(spark):
    df = spark.createDataFrame([(1, i, float(t), 0.0) for i, t in enumerate([0, 3, 6, 7])], "session_id long, candidate_id long, ts double, score double")
    assert [(r.ts, r.merged) for r in replay.merge_boundaries(df, 5.0).orderBy("ts").collect()] == [(0, 2), (6, 2)]


def ranks_by_hand(rows, gap):
    """(session, id) to rank: each next one the best that is far from all taken, else the best left."""
    out = {}
    for session in {r[0] for r in rows}:
        left, took = sorted((-s, t, i) for c, i, t, s in rows if c == session), []
        while left:
            one = next((x for x in left if all(abs(x[1] - y[1]) >= gap for y in took)), left[0])
            left.remove(one)
            took.append(one)
        out |= {(session, i): k for k, (_, _, i) in enumerate(took, 1)}
    return out


def test_diverse_rank_ranks_every_candidate(spark):
    from tests.conftest import SF
    from tidemark.plans import models

    rng = random.Random(4)
    rows = [(c, c * 100 + i, float(rng.randrange(40)), rng.randrange(5) / 4) for c in range(3) for i in range(60)] + [(9, 1, 5.0, 0.5)]
    got = replay.diverse_rank(spark.createDataFrame(rows, "session_id long, candidate_id long, ts double, score double"), 6.0).collect()
    assert len(got) == len(rows) and {(r.session_id, r.candidate_id): r["rank"] for r in got} == ranks_by_hand(rows, 6.0)
    every = [tuple(r) for r in models._candidates(spark, SF).collect()]
    got = models.diverse_rank(spark, SF).collect()
    assert len(got) == len(every) and {(r.session_id, r.candidate_id): r["rank"] for r in got} == ranks_by_hand(every, 86400.0)


def test_token_clusters_use_short_words(spark, tmp_path):
    """Four texts of words under nine characters, two of them of the same words: before, no word of them was left."""
    from tidemark.operators import audits
    from tidemark.plans import audits as plans

    texts = ["red fox ran off", "off ran fox red", "blue cat sat on", "wet dog", " "]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.sample: r.cluster for r in plans.token_clusters(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[0] == got[1] and len(set(got.values())) == 3
    at_once, audits.TOKENS_AT_ONCE = audits.TOKENS_AT_ONCE, 2
    try:
        assert got == {r.sample: r.cluster for r in plans.token_clusters(spark, str(tmp_path)).collect()}
    finally:
        audits.TOKENS_AT_ONCE = at_once


def _frame(sport, dport, payload, proto=6):
    seg = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 2, 0, 0, 0) + payload if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([198, 18, 0, 1])) + seg
    return b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00" + ip


def _hello(name):
    ext = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\x00" + struct.pack(">H", len(ext)) + ext
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + struct.pack(">I", len(body))[1:] + body


def test_capture_source(spark, tmp_path):
    dns = struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + b"\x03www\x01x\x00" + struct.pack(">HH", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    frames = [_frame(40000, 443, _hello(b"shop.example.com")), _frame(53, 40001, dns, 17)]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 100 + i, 500000, len(f), len(f) + 9) + f for i, f in enumerate(frames)) + b"\x01\x02"
    (tmp_path / "a.pcap").write_bytes(data)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    block = lambda k, b: struct.pack("<II", k, len(b) + 12) + b + struct.pack("<I", len(b) + 12)
    ng = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 3, 0, 0))
    ng += block(6, struct.pack("<IIIII", 0, 0, 100500, len(frames[0]), len(frames[0])) + pad(frames[0]))
    (tmp_path / "b.pcapng").write_bytes(ng)
    pcap.register(spark)
    got = spark.read.format("packets").load(str(tmp_path)).orderBy("capture", "idx").collect()
    assert [(r.capture, r.ts, r.proto, r.sni) for r in got] == [("a.pcap", 100.5, "TCP", "shop.example.com"), ("a.pcap", 101.5, "UDP", None), ("b.pcapng", 100.5, "TCP", "shop.example.com")]
    assert got[0].length == len(frames[0]) + 9 and [tuple(a) for a in got[1].dns_answers] == [("1.2.3.4", "www.x")]
    assert spark.read.format("packets").option("start", "101").option("end", "101.5").load(str(tmp_path)).count() == 1


def test_json_sources(spark):
    flow = '{"10.0.0.1,5,8.8.8.8,443,6": {"packet_data": {"timestamp": [1.5, 2.5], "packet_dir": [0, 1], "IP_packet_bytes": [60], "TCP_flags": ["SA"]}}, "a,1,b,2,1": {"packet_data": {"timestamp": [1.0]}}}'
    got = documents.flow_packets(spark.createDataFrame([("c", flow)], "capture_id string, json string")).orderBy("idx").collect()
    assert [(r.ts, r.length, r.direction, r.tcp_flags, r.role) for r in got] == [(1.5, 60, "up", 18, "unknown"), (2.5, 0, "down", 0, "unknown")]
    har = '﻿{"log": {"entries": [{"startedDateTime": "1970-01-01T00:00:10Z", "time": 500, "serverIPAddress": "[::1]", "request": {"method": "GET", "url": "https://A.b/c"}, "response": {"status": 200, "bodySize": 7, "_transferSize": -1}}]}}'
    r = documents.har_entries(spark.createDataFrame([("c", har), ("d", "{broken")], "capture_id string, json string")).collect()
    assert [(x.host, x.server_ip, x.start, x["end"], x.bytes) for x in r] == [("a.b", "::1", 10.0, 10.5, 7)]


def test_manifest_rejects_repeats(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"capture_id": "a", "label": null}\n\n{"capture_id": "b", "label": "x"}\n')
    assert {r.capture_id: r.label for r in documents.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()} == {"a": "", "b": "x"}
    (tmp_path / "m.jsonl").write_text('{"capture_id": "a"}\n{"capture_id": "a"}\n')
    with pytest.raises(Exception, match="repeated capture_id"):
        documents.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()


def test_blocks_carry_survivors_and_forget_the_suppressed(spark):
    from tidemark.operators import sites

    rng = random.Random(8)
    rows = [(c, i, float(rng.randrange(100)), float(rng.randrange(9))) for c in range(4) for i in range(40)]
    got = {c: [] for c in range(4)}
    for r in sites.suppress_in_blocks(spark.createDataFrame(rows, "capture_id long, event_id long, ts double, score double"), 7.0, 20.0, 1.0).orderBy("capture_id", "rank").collect():
        assert r.emit_ts >= r.ts + 8
        got[r.capture_id].append(r.event_id)
    for c in range(4):
        mine = [(-s, t, i) for cc, i, t, s in rows if cc == c]
        t0, carry, out = min(t for _, t, _ in mine), [], []
        for b in range(6):
            end = t0 + 20 * (b + 1)
            kept = []
            for x in sorted(carry + [m for m in mine if end - 20 <= m[1] < end]):
                if all(abs(x[1] - k[1]) > 7 for k in kept):
                    kept.append(x)
            carry = [k for k in kept if k[1] >= end - 7]
            out += [k for k in kept if k[1] < end - 7]
        assert got[c] == [i for _, t, i in sorted(out + carry, key=lambda k: (k[1], k[2]))]


def test_addresses_and_ends(spark):
    from tidemark.operators import sites

    rows = [(1, "10.0.0.5", "8.8.8.8", 50000, 443, 2), (1, "8.8.8.8", "10.0.0.5", 443, 50000, 18), (2, "9.9.9.9", "8.8.4.4", 1, 80, 2), (2, "8.8.4.4", "9.9.9.9", 80, 1, 16)]
    df = spark.createDataFrame(rows, "capture_id long, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int")
    assert {r.capture_id: r.ip for r in sites.local_address(df).collect()} == {1: "10.0.0.5", 2: "9.9.9.9"}
    assert sorted((r.capture_id, r.direction) for r in sites.with_direction(df).collect()) == [(1, "down"), (1, "up"), (2, "down"), (2, "up")]


def test_clusters_presets_and_sinks(spark, tmp_path):
    from tidemark.operators import audits
    from tidemark.sources import sinks

    d = [[0, .1, .9, .9], [.1, 0, .8, .9], [.9, .8, 0, .2], [.9, .9, .2, 0]]
    assert audits.average_linkage(d, 0.5) == [0, 0, 1, 1] and audits.average_linkage(d, 2) == [0, 0, 0, 0] and audits.average_linkage(d, 0.05) == [0, 1, 2, 3]
    df = spark.createDataFrame([(1, 2.0, 4.0, "x"), (2, 3.0, 6.0, "y"), (3, 1.0, 2.1, "z")], "rpc_n int, a_x double, a_y double, name string")
    assert audits.feature_columns(df, parts=["rpc"]) == ["a_x", "a_y"] and audits.prune_correlated(df, ["a_x", "a_y"]) == ["a_x"]
    assert audits.preset(df.columns, {"base": {"prefixes": ["a_", "rpc"]}, "without": ["rpc"]}) == ["a_x", "a_y"]
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, "name") == 3 and sinks.append_new(df, path, "name") == 0 and spark.read.parquet(path).count() == 3
    assert sinks.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert sinks.run_contract({"x": 1}, {"t": df})["fingerprint"] == sinks.run_contract({"x": 1}, {"t": df})["fingerprint"]
    assert "| rpc_n |" in sinks.markdown(df.select("rpc_n"))


def test_scans_carry_state_over_batches_nulls_and_no_rows(spark):
    """Admissions and running medians against plain loops, in Arrow batches of seven rows; a null key is a key, a null score the lowest."""
    rng = random.Random(11)
    schema = "session_id long, candidate_id long, ts double, score double"
    rows = [(rng.choice([1, 2, None]), i, float(rng.randrange(30)), rng.choice([None, 0.1, 0.2, 0.3, 0.4])) for i in range(150)]
    df = spark.createDataFrame(rows, schema)
    assert replay.ever_admitted(df.limit(0), 3).count() == 0 and replay.diverse_rank(df.limit(0), 3.0).count() == 0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.session_id, r.candidate_id): r.admitted for r in replay.ever_admitted(df, 3).collect()}
        merged = {(r.session_id, r.ts): r.merged for r in replay.merge_boundaries(df, 4.0).collect()}
        packets = spark.createDataFrame([(s or 0, i, t, i % 7, 0) for s, i, t, _ in rows], "capture_id long, event_id long, ts double, length long, payload_len long")
        med = {(r.capture_id, r.event_id): r.running_median for r in ordered.shape_rows(packets).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, bounds, mids = {}, {}, {}
    for s in {r[0] for r in rows}:
        before, first, sizes = [], None, []
        for _, i, t, x in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            x = float("-inf") if x is None else x
            want[s, i] = sum(b >= x for b in before) < 3
            before.append(x)
            first = t if first is None or t - first > 4.0 else first
            bounds[s, first] = bounds.get((s, first), 0) + 1
            sizes.append(math.log1p(i % 7))
            mids[s or 0, i] = statistics.median(sizes)
    assert got == want and merged == bounds
    assert med.keys() == mids.keys() and all(abs(med[k] - mids[k]) < 1e-9 for k in mids)


def clusters_by_matrix(rows, threshold):
    """Clusters of each block's samples from the whole matrix of distances; rows are (block, sample, words)."""
    import numpy as np
    from tidemark.operators import audits

    held, where = {}, {}
    for block, sample, words in rows:
        if words:
            held.setdefault((block, sample), set()).update(words)
            for w in words:
                where.setdefault(w, set()).add(sample)
    total, out = len({s for _, s in held}), {}
    for block in {b for b, _ in held}:
        names, vocabulary = sorted(s for b, s in held if b == block), sorted(where)
        m = np.array([[(math.log((total + 1) / (len(where[w]) + 1)) + 1) * (w in held[block, s]) for w in vocabulary] for s in names])
        u = m / np.linalg.norm(m, axis=1)[:, None]
        out |= {(block, s): c for s, c in zip(names, audits.average_linkage(np.round(1 - u @ u.T, 12), threshold))}
    return out


@pytest.mark.parametrize("again", [False, True])
def test_token_clusters_match_a_matrix(spark, again):
    """Near and equal samples, words of one sample and, again, samples in several rows and blocks; in Arrow batches of seven rows."""
    from tidemark.operators import audits

    draw = random.Random(5)
    themes = [[f"t{k}w{i}" for i in range(9)] for k in range(6)]
    rows = []
    for i in range(90):
        words = set(draw.sample(draw.choice(themes), draw.randint(2, 7)) + draw.sample(range(40), 2) + ([f"own{i}"] if i % 3 == 0 else []))
        rows.append((f"b{i % 3}", i, sorted(map(str, words))))
    rows += [("b0", 200 + i, rows[i][2]) for i in range(6)] + [("b1", 300, [])]
    if again:
        rows += [("b0", 0, ["more", "own0"]), ("b2", 3, ["0", "own3"])]
    df = spark.createDataFrame(rows, "block string, sample long, words array<string>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for threshold in (0.2, 0.5, 0.75, 1.0):
            got = {(r.block, r.sample): r.cluster for r in audits.cluster_by_tokens(df, "block", threshold).collect()}
            assert got == clusters_by_matrix(rows, threshold) and (threshold > 0.7 or len(set(got.values())) > 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_token_clusters_hold_no_matrix():
    """3000 vectors of 5 entries: a matrix would be 72 MB."""
    import tracemalloc

    import numpy as np
    from tidemark.operators import linkage

    draw = np.random.default_rng(3)
    n, k = 3000, 5
    col = (draw.integers(0, 300, n)[:, None] * 20 + np.argsort(draw.random((n, 20)), axis=1)[:, :k]).ravel()
    tracemalloc.start()
    got = linkage.clusters(np.arange(0, n * k + 1, k), col, np.ones(6000), np.full(n, math.sqrt(k)), np.ones(n, dtype=bool), 0.75, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6 and 300 <= len(set(got.tolist())) < n


@pytest.mark.parametrize("name", ["segment_stats", "flow_shape_change", "candidate_scan_score"])
def test_segments_without_bytes_match_sql(spark, tmp_path, name):
    """Flows of no bytes, alone in a segment, beside others and before and after a grid time; such a segment's shares are not numbers."""
    import duckdb
    from tests.conftest import rows_of
    from tidemark.plans import evidence

    draw, n = random.Random(9), 400
    rows = [(i, 1704067200.0 + draw.randint(0, 20 * 86400), i % 3, draw.choice(["view", "click", "purchase", "signup", "error"]), 0.0 if i % 3 == 2 or i % 4 == 0 else draw.random() * 900, f'{{"k": {i % 4}}}') for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double, props string")
    df.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(evidence.ORACLES[name]).df()
    got = evidence.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) and rows_of(got) == rows_of(want)
    if name == "segment_stats":
        assert got[got.bytes_total == 0].up_byte_frac.isna().all() and (got[got.bytes_total == 0].intrinsic_salience == 1).all() and (got.bytes_total == 0).any()


TOKEN_QUERIES = ["family_key_hash", "shared_support", "cluster_quality", "family_components", "token_coverage", "token_df", "family_pair_jaccard"]


@pytest.mark.parametrize("name", TOKEN_QUERIES)
def test_tokens_are_counted_before_they_are_shuffled(spark, tmp_path, name):
    """Repeated, null and wordless documents as in SQL; of other tables no sample's id goes to a shuffle with a token, and words are made once a scan."""
    import re

    import duckdb
    from tests.conftest import SF, rows_of
    from tidemark.plans import catalog

    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randint(0, 60)}x" for _ in range(12)) for _ in range(60)] + ["", None, "a bc \t", "Ab\tABC\nabc  abc"]
    rows = [(i, f"s{i % 7}", t) for i, t in enumerate(texts)] + [(3, "s3", "more words w1x"), (4, "s5", "w1x w2x")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert len(got) and rows_of(got) == rows_of(want)
    if name != "family_components":  # its rounds are planned apart
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\([^)\n]*sample", plan) and max(line.count("split(") for line in plan.splitlines()) == 1


def test_concurrent_flows_make_no_bins(spark):
    """Flows against a count by bin; one flow of 10^12 bins, which made no array before; gaps and flows that meet in a bin."""
    draw, rows = random.Random(2), []
    for i in range(300):
        rows.append((i, i % 4, f"f{draw.randint(0, 9)}", draw.randint(0, 30) * 7.5 + (1000 if i % 3 == 0 and i % 4 == 1 else 0)))
    df = spark.createDataFrame([*rows, (300, 9, "f", 0.5), (301, 9, "f", 1e12 - 0.5), (302, 9, "g", 3.0)], "event_id long, capture_id long, flow_id string, ts double")
    got = {r.capture_id: (r.max_flows, r.mean_flows) for r in windows.concurrent_flows(df).collect()}
    assert got.pop(9) == (2, pytest.approx(1 + 1e-12))
    for c in range(4):
        bins = {}
        for f in range(10):
            at = [int(t // 1) for _, k, flow, t in rows if k == c and flow == f"f{f}"]
            for b in range(min(at), max(at) + 1) if at else ():
                bins[b] = bins.get(b, 0) + 1
        assert got.pop(c) == (max(bins.values()), pytest.approx(sum(bins.values()) / len(bins)))
    assert not got

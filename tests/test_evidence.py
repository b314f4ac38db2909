"""Roles, endpoints, markup, presets, captures and manifests on small cases."""

import io
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import endpoints, markup, net
from tidemark.operators import attribution, grouping, manifests, presets
from tidemark.sources import pcap


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path,want", [
    ("/A/12/1234//x/", "/a/{n}/{num}/x"), ("", "/"), (None, "/"), ("v1/u", "/v1/u"), ("/0x" + "a" * 40 + "/t", "/{addr}/t"), ("/k-" + "b" * 32, "/k-{hex}"), ("/01234567-89ab-cdef-0123-456789abcdef", "/{uuid}"), ("/a1/2b", "/a1/2b"),
])
def test_paths(spark, path, want):
    assert one(spark, path, net.mask_path) == want


@pytest.mark.parametrize("url,want", [
    ("https://own.com/api/Save/12?b=1&a=2", "/api/save/{n}?a&b"), ("https://x.own.com/api", "/api"), ("https://other.net:8443/api/7", "other.net/api/{n}"), ("https://own.com/a.js", ""), ("https://rpc.infura.io/v3", ""), ("data:abc", ""), ("https://own.com/home", ""), (None, ""),
])
def test_endpoints(spark, url, want):
    assert one(spark, url, lambda x: net.canonical_endpoint(x, F.lit("own.com"))) == want


def test_markup(spark):
    page = "<title>T</title><style>a{}</style><p>Pay 12.50 to 0x" + "A" * 40 + " &amp; go</p><script>if (a<b) x('y')</script> 3 < 4 é $5"
    assert one(spark, page, markup.visible_text) == "t pay num to addr go num num $ num"
    script = "/* c\nc */ var a = 'some text'; // note\nfetch(\"https://h/x\") + 12.5; b = 'http://u'"
    assert one(spark, script, markup.normalize_script) == "var a = STR ; fetch( STR ) + NUM ; b = STR"
    assert one(spark, "a /* open", markup.without_comments) == "a /* open" and one(spark, "http://x // y", markup.without_comments) == "http://x  "
    assert one(spark, "a < b <i>c</i>", markup.without_tags).split() == ["a", "b", "c"]


def test_scripts_and_fields(spark):
    assert one(spark, "/js/jquery.min.js", endpoints.useful_script) is False and one(spark, "/js/steal-7.js", endpoints.useful_script) is True and one(spark, None, endpoints.useful_script) is False
    assert one(spark, "https://cdn.jsdelivr.net/x", lambda x: endpoints.url_token(x, F.lit("a.com"))) == "" and one(spark, "https://A.com/P", lambda x: endpoints.url_token(x, F.lit("a.com"))) == "/p"
    assert one(spark, "h.com/q8z7y6x5/api/v1", endpoints.steady_token) == "h.com/{rand}/api/v1" and one(spark, "/index_22.html", endpoints.steady_token) == "/index_{n}.html"
    assert one(spark, "h.com/a/b", endpoints.strip_host) == "/a/b" and one(spark, "/a", endpoints.strip_host) == "/a" and one(spark, "abc", endpoints.strip_host) == "abc"
    assert one(spark, " Wallet Address! ", endpoints.field_name) == "wallet_address" and one(spark, "URL", lambda x: endpoints.field_name(x, ("url",))) == ""
    for name, want in (("wallet_address", True), ("colour", False), ("a_b_c_d_e_f_token", False), ("wallet_b_c_d_e_f_token", True), ("", False)):
        assert one(spark, name, endpoints.is_schema_signal) is want
    got = one(spark, "x", lambda x: endpoints.own_tokens(F.array(F.lit("h/a"), F.lit("h/m/metrics"), F.lit("h/q?projectId=1"), F.lit("k/a")), F.array(F.lit("s" * 200)), "/metrics$"))
    assert got == ["ep:/a", "sc:" + "s" * 120]


def test_presets():
    names = ["base_iat", "role_wallet_vendor_frac", "rpc_n", "phase_first_party_bytes", "har_n", "flow_dur", "role_unknown"]
    assert presets.columns(names, "traffic_family") == ["base_iat", "rpc_n", "flow_dur", "role_unknown"]
    assert presets.columns(names, "traffic_family_no_rpc") == ["base_iat", "flow_dur", "role_unknown"]
    assert presets.columns(names, "strict_wallet_agnostic") == ["base_iat", "phase_first_party_bytes", "har_n", "flow_dur"]
    assert presets.columns(names, "timing_core") == ["base_iat", "phase_first_party_bytes", "flow_dur"] and presets.columns(names, "all") == names
    assert presets.scenarios([0.0, 1.0], [0.5, 0.5]) == [{"sni": 0.0, "dns": 0.5}, {"sni": 1.0, "dns": 0.5}]
    assert presets.parse_grid("0, .5,0.5,1") == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        presets.parse_grid("2")


def ether(kind, body):
    return b"\0" * 12 + kind + body


def classic(frames):
    return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, 0, len(f), len(f)) + f for f in frames)


class Dribble(io.RawIOBase):
    """Gives at most three bytes a read."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n=-1):
        out = self.data[self.at:self.at + min(n, 3)]
        self.at += len(out)
        return out


def test_padded_frames_and_small_reads():
    udp = struct.pack(">HHHH", 1000, 53, 8 + 5, 0) + b"hello"
    six = struct.pack(">IHBB", 6 << 28, len(udp), 17, 64) + b"\1" * 16 + b"\2" * 16 + udp + b"\0" * 9
    four = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp) + 4, 0, 0, 64, 17, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + udp + b"pad!" + b"\0" * 7
    short = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40, 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + struct.pack(">HHIIBBHHH", 1, 443, 0, 0, 3 << 4, 0, 0, 0, 0)
    data = classic([ether(b"\x86\xdd", six), ether(b"\x08\0", four), ether(b"\x08\0", short)])
    rows = list(pcap.packets("f", data))
    assert [(r[4], r[5], r[11]) for r in rows] == [(6, "UDP", 5), (4, "UDP", 5)]
    assert list(pcap.packets("f", Dribble(data))) == rows
    assert list(pcap.packets("f", data[:-3])) == rows and list(pcap.packets("f", data[:30])) == []


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "k", "A\\B/"), (2, "k", "a/c")], "id long, sample string, path string").withColumn("p", manifests.canonical_path(F.col("path")))
    right = spark.createDataFrame([(1, "k", "a/b", "f1"), (3, None, "a/c", "f2")], "id long, sample string, p string, fam string")
    assert manifests.pick_key(left, right, ["sample", "p", "id"]) == "p"
    assert {(r.id, r.fam) for r in manifests.join_labels(left, right, ["sample", "p"], ["fam"]).collect()} == {(1, "f1"), (2, "f2")}
    with pytest.raises(ValueError):
        manifests.pick_key(left, right, ["sample"])
    with pytest.raises(Exception, match="no fam"):
        manifests.matched_or_error(left, right, "id", "fam").collect()
    with pytest.raises(Exception, match="repeated sample"):
        manifests.unique_or_error(left, "sample").collect()
    with pytest.raises(ValueError):
        manifests.weights_without_leak(left, left, right.withColumn("weight", F.lit(1.0)), "id")
    with pytest.raises(Exception, match="no action"):
        attribution.clip_before_action(spark.createDataFrame([(1, 2.0)], "capture_id long, ts double"), spark.createDataFrame([], "capture_id long, first_action double")).collect()


def test_pairs_with_common_tokens_are_exact(spark):
    rows = [(f"f{i}", "c", f"t{j}") for i in range(6) for j in range(4) if (i + j) % 3 or j == 0]
    df = spark.createDataFrame(rows, "family string, channel string, token string")
    whole = {(r.a, r.b): r.shared_c for r in grouping.pair_metrics(df, ["c"]).collect()}
    some = {(r.a, r.b): r.shared_c for r in grouping.pair_metrics(df, ["c"], most=4).collect()}
    assert some and all(whole[k] == n for k, n in some.items())

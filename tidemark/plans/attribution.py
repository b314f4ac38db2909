"""Queries over events as packets with addresses and server names, documents as manifests, and pages as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as at
from tidemark.operators import grouping, manifests
from tidemark.plans.mapping import P, packets, predictions, rounded, table
from tidemark.plans.mapping import PREDICTIONS

QUERIES, ORACLES = {}, {}
#: Roles of the stand-in hosts h0 to h22, by number modulo 5, and their priority.
ROLES = ["rpc_provider", "unknown", "first_party_site", "third_party_static", "analytics_ads"]
PRIORITY = ["rpc_provider", "first_party_site", "third_party_static", "analytics_ads", "unknown"]


def query(sql: str, base: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + base if base else "") + sql
        return f
    return add


def _classify(host):
    return F.get(F.array(*map(F.lit, ROLES)), F.pmod(F.regexp_extract(host, r"(\d+)", 1).cast("int"), F.lit(5)))


def _named(spark, sf_dir):
    """packets with addresses, ports and, on a quarter of them, a server name; the server is event_id modulo 23."""
    p = packets(spark, sf_dir)
    server, client = F.concat(F.lit("198.51.100."), (F.col("event_id") % 23).cast("string")), F.concat(F.lit("10.0.0."), (F.col("capture_id") % 7).cast("string"))
    up = F.col("direction") == "up"
    port = F.when(F.col("event_id") % 2 == 0, 443).otherwise(5000)
    return p.drop("role").withColumn("src", F.when(up, client).otherwise(server)).withColumn("dst", F.when(up, server).otherwise(client)).withColumn("sport", F.when(up, 40000).otherwise(port)).withColumn("dport", F.when(up, port).otherwise(40000)).withColumn(
        "sni", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("h"), (F.col("event_id") % 23).cast("string"), F.lit(".example.net"))))


def _entries(spark, sf_dir, every):
    """(capture_id, ip, host): what every so-manieth event tells of its server; neighbouring servers share an address."""
    p = packets(spark, sf_dir).where(F.col("event_id") % every == 0)
    return p.select("capture_id", F.concat(F.lit("198.51.100."), (F.floor(F.col("event_id") % 23 / 2) * 2).cast("string")).alias("ip"), F.concat(F.lit("H"), (F.col("event_id") % 23).cast("string"), F.lit(".example.net")).alias("host"))


_ROLE = "([" + ", ".join(map(repr, ROLES)) + "])[regexp_extract({0}, '(\\d+)', 1)::INT % 5 + 1]"
_RANK = "list_position([" + ", ".join(map(repr, PRIORITY)) + "], {0})"
_NP = P + f""", np AS (SELECT * EXCLUDE (role), CASE WHEN direction = 'up' THEN '10.0.0.' || (capture_id % 7) ELSE '198.51.100.' || (event_id % 23) END AS src, CASE WHEN direction = 'up' THEN '198.51.100.' || (event_id % 23) ELSE '10.0.0.' || (capture_id % 7) END AS dst,
  '198.51.100.' || (event_id % 23) AS ip, CASE WHEN event_id % 4 = 0 THEN 'h' || (event_id % 23) || '.example.net' END AS sni FROM p),
fl AS (SELECT capture_id, flow_id, arg_max(sni, struct_pack(ts, sni)) AS hosts FROM np WHERE sni IS NOT NULL GROUP BY 1, 2),
fr AS (SELECT *, {_ROLE.format('hosts')} AS role FROM fl)"""


def _ips(name, every):
    return f""", {name}e AS (SELECT DISTINCT capture_id, '198.51.100.' || ((event_id % 23) // 2 * 2) AS ip, 'h' || (event_id % 23) || '.example.net' AS host FROM p WHERE event_id % {every} = 0),
{name} AS (SELECT capture_id, ip, string_agg(host, '|' ORDER BY host) AS hosts, arg_min({_ROLE.format('host')}, struct_pack(k := {_RANK.format(_ROLE.format('host'))}, r := {_ROLE.format('host')})) AS role FROM {name}e GROUP BY 1, 2)"""


_COUNTED = " SELECT capture_id, role, count(*) AS n, sum(length)::BIGINT AS bytes, count(DISTINCT hosts) AS n_hosts FROM a GROUP BY 1, 2"


def _counted(rows):
    return rows.groupBy("capture_id", "role").agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("bytes"), F.countDistinct("hosts").alias("n_hosts"))


def _assigned(first, second=None):
    """SQL of a: packets with the role and hosts of the first that names them."""
    parts = [x for x in (first, second) if x]
    on = {"fr": "USING (capture_id, flow_id)", "har": "USING (capture_id, ip)", "dns": "USING (capture_id, ip)"}
    pick = lambda c: "CASE " + " ".join(f"WHEN coalesce({x}.role, 'unknown') <> 'unknown' THEN {x}.{c}" for x in parts) + f" ELSE {'NULL' if c == 'hosts' else repr('unknown')} END AS {c}"
    return f", a AS (SELECT np.*, {pick('role')}, {pick('hosts')} FROM np " + " ".join(f"LEFT JOIN {x} {on[x]}" for x in parts) + ")"


@query(_ips("har", 9) + _assigned("har") + _COUNTED, _NP)
def role_by_har(spark, sf_dir):
    return _counted(at.assign_roles(_named(spark, sf_dir), _classify, PRIORITY, har=_entries(spark, sf_dir, 9), order=("har",)))


@query(_ips("dns", 7) + _assigned("fr", "dns") + _COUNTED, _NP)
def role_by_name_else_dns(spark, sf_dir):
    return _counted(at.assign_roles(_named(spark, sf_dir), _classify, PRIORITY, dns=_entries(spark, sf_dir, 7), order=("sni", "dns")))


@query(_ips("har", 9) + _assigned("har", "fr") + _COUNTED, _NP)
def role_by_har_else_name(spark, sf_dir):
    return _counted(at.assign_roles(_named(spark, sf_dir), _classify, PRIORITY, har=_entries(spark, sf_dir, 9)))


def _with_roles(spark, sf_dir):
    return at.assign_roles(_named(spark, sf_dir), _classify, PRIORITY, har=_entries(spark, sf_dir, 9))


_A = _NP + _ips("har", 9) + _assigned("har", "fr")


@query(_ips("dns", 7) + ", s AS (SELECT capture_id, count(DISTINCT sni) AS sni_hosts, count(DISTINCT ip) FILTER (sni IS NOT NULL) AS sni_ips FROM np GROUP BY 1), d AS (SELECT capture_id, count(DISTINCT host) AS dns_hosts, count(DISTINCT ip) AS dns_ips FROM dnse GROUP BY 1) SELECT capture_id, sni_hosts, sni_ips, coalesce(dns_hosts, 0) AS dns_hosts, coalesce(dns_ips, 0) AS dns_ips FROM s LEFT JOIN d USING (capture_id)", _NP)
def observation_counts(spark, sf_dir):
    return at.observation_counts(_named(spark, sf_dir), _entries(spark, sf_dir, 7))


@query(" SELECT capture_id, count(*) AS n FROM a WHERE role = 'rpc_provider' OR hosts IS NULL OR len(list_filter(string_split(hosts, '|'), lambda h: h <> 'h7.example.net' AND regexp_matches(h, '^h1|7\\.'))) = 0 GROUP BY 1", _A)
def host_pattern_suppression(spark, sf_dir):
    return at.suppress_hosts(_with_roles(spark, sf_dir), ["^h1", r"7\."], ("rpc_provider",), ("h7.example.net",)).groupBy("capture_id").agg(F.count("*").alias("n"))


@query(", hh AS (SELECT capture_id, list(DISTINCT host) AS hs FROM hare GROUP BY 1) SELECT capture_id, count(*) AS n FROM a LEFT JOIN hh USING (capture_id) WHERE NOT (role IN ('analytics_ads', 'third_party_static') AND NOT coalesce(list_has_any(string_split(hosts, '|'), hs), FALSE)) GROUP BY 1", _A)
def har_guarded_suppression(spark, sf_dir):
    return at.suppress_roles_unless_har(_with_roles(spark, sf_dir), ["analytics_ads", "third_party_static"], _entries(spark, sf_dir, 9)).groupBy("capture_id").agg(F.count("*").alias("n"))


@query(" SELECT capture_id, count(*) AS n, count(DISTINCT role) AS roles FROM a WHERE role <> 'unknown' GROUP BY 1", _A)
def known_roles_only(spark, sf_dir):
    return at.known_only(_with_roles(spark, sf_dir)).groupBy("capture_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"))


@query(", m AS (SELECT capture_id, 'ENC443|' || least(src, dst) || '|' || greatest(src, dst) AS flow_id, CASE WHEN proto = 'TCP' THEN payload_len > 0 ELSE payload_len >= 48 END AS keep, payload_len FROM np) SELECT flow_id, count(*) AS n, sum(payload_len)::BIGINT AS bytes FROM m WHERE keep GROUP BY 1", _NP)
def transport_norm_merge(spark, sf_dir):
    from tidemark.operators.shares import unify_transport

    return at.merge_encrypted(unify_transport(_named(spark, sf_dir))).groupBy("flow_id").agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("bytes"))


@query(", f AS (SELECT capture_id, min(ts) FILTER (role = 'purchase') AS first_action FROM p GROUP BY 1) SELECT capture_id, count(*) AS n, round(min(ts), 3) AS first_ts FROM p JOIN f USING (capture_id) WHERE first_action IS NOT NULL AND ts >= first_action GROUP BY 1", P)
def clip_before_action(spark, sf_dir):
    p = packets(spark, sf_dir)
    first = p.where("role = 'purchase'").groupBy("capture_id").agg(F.min("ts").alias("first_action"))
    clipped = at.clip_before_action(p.join(first.select("capture_id"), "capture_id", "left_semi"), first)
    return clipped.groupBy("capture_id").agg(F.count("*").alias("n"), F.round(F.min("ts"), 3).alias("first_ts"))


@query(" SELECT capture_id, role, sum(length)::BIGINT AS bytes FROM a GROUP BY 1, 2", _A)
def role_byte_counter(spark, sf_dir):
    return at.role_bytes(_with_roles(spark, sf_dir))


@query(" SELECT capture_id, round(sum(CASE WHEN role IN ('view', 'error') THEN length ELSE 0 END) / (sum(CASE WHEN role = 'click' THEN length ELSE 0 END) + 1), 6) AS passive_to_click, round(sum(CASE WHEN role = 'purchase' THEN length ELSE 0 END) / (sum(CASE WHEN role IN ('signup', 'click') THEN length ELSE 0 END) + 1), 6) AS purchase_to_entry FROM p GROUP BY 1", P)
def cross_role_ratios(spark, sf_dir):
    return rounded(at.cross_role_ratios(packets(spark, sf_dir), {"passive_to_click": (["view", "error"], ["click"]), "purchase_to_entry": (["purchase"], ["signup", "click"])}))


_SHARE = ", ".join(f"round(CASE WHEN count(*) FILTER ({c}) = 0 THEN 0 ELSE count(*) FILTER ({c} AND proto = '{x}') / count(*) FILTER ({c}) END, 6) AS {n}_{x.lower()}_frac" for n, c in (("all", "TRUE"), ("click", "role = 'click'"), ("view", "role = 'view'")) for x in ("TCP", "UDP"))


@query(f" SELECT capture_id, {_SHARE} FROM p GROUP BY 1", P)
def protocol_shares(spark, sf_dir):
    return rounded(at.protocol_shares(packets(spark, sf_dir), ["click", "view"]))


@query(", e AS (SELECT event_id, CASE WHEN direction = 'down' THEN src ELSE dst END AS ip, CASE WHEN event_id % 2 = 0 THEN 443 ELSE 5000 END AS port FROM np) SELECT ip, port, port = 443 AS web, count(*) AS n FROM e GROUP BY ALL", _NP)
def remote_endpoints(spark, sf_dir):
    r = at.remote_endpoint(*[F.col(c) for c in ("direction", "src", "sport", "dst", "dport")])
    return _named(spark, sf_dir).select(r.alias("r")).groupBy(F.col("r.ip"), F.col("r.port"), F.col("r.web")).agg(F.count("*").alias("n"))


def _manifest(spark, sf_dir):
    """documents as a manifest: paths in two notations, one of them not unique."""
    path = F.concat(F.lit("Data\\Captures/"), F.col("source"), F.lit("/Doc-"), F.col("doc_id").cast("string"), F.lit(".JSON/"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", path.alias("path"), F.concat(F.lit("key-"), F.col("source")).alias("sample_key"))


@query(" SELECT doc_id, 'data/captures/' || source || '/doc-' || doc_id || '.json' AS path, 'doc-' || doc_id || '.json' AS file, 'doc-' || doc_id AS stem, source || '/doc-' || doc_id || '.json' AS below FROM documents")
def path_keys(spark, sf_dir):
    p = F.col("path")
    return _manifest(spark, sf_dir).select("doc_id", manifests.canonical_path(p).alias("path"), manifests.file_name(p).alias("file"), manifests.stem(p).alias("stem"), manifests.below(p, "captures").alias("below"))


@query(" SELECT doc_id, 'fam' || (doc_id % 17) AS family, l.quality FROM documents LEFT JOIN labels l USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels)")
def adaptive_label_join(spark, sf_dir):
    """The sample key repeats and the file names differ, so the join takes the document's id."""
    left = _manifest(spark, sf_dir).withColumn("file", manifests.file_name(F.col("path")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("x").alias("sample_key"), F.concat(F.lit("fam"), (F.col("doc_id") % 17).cast("string")).alias("family"))
    return manifests.join_labels(left, labels, ["sample_key", "file", "doc_id"], ["family", "quality"]).where("family is not null").select("doc_id", "family", "quality")


@query(", c AS (SELECT capture_id AS session_id, row_number() OVER (PARTITION BY capture_id ORDER BY ts, event_id) - 1 AS rank, event_id, length FROM p), s AS (SELECT session_id, rank, length / 100.0 AS score FROM c WHERE rank % 3 = 0) SELECT c.session_id, c.rank, round(s.score::DOUBLE, 6) AS score FROM c LEFT JOIN s USING (session_id, rank)", P)
def onset_score_alignment(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("capture_id").orderBy("ts", "event_id")) - 1
    c = packets(spark, sf_dir).select(F.col("capture_id").alias("session_id"), place.alias("rank"), "length")
    scores = c.where("rank % 3 = 0").select("session_id", "rank", (F.col("length") / 100.0).alias("score"))
    return rounded(manifests.align_scores(c, scores).select("session_id", "rank", "score"))


@query(", c AS (SELECT event_id, (['oracle', 'oracle_jitter_1', 'heuristic'])[event_id % 3 + 1] AS source, event_id % 6 AS rank, (['w5', 'w10', 'w20'])[event_id % 7 % 3 + 1] AS win FROM p) SELECT event_id, (source = 'oracle' AND rank = 0) OR source LIKE 'oracle!_jitter!_%' ESCAPE '!' OR (source = 'heuristic' AND rank BETWEEN 1 AND 3) AS train, source = 'heuristic' AND rank BETWEEN 1 AND 3 AND win IN ('w5', 'w20') AS candidate FROM c", P)
def candidate_masks(spark, sf_dir):
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    e = F.col("event_id")
    c = packets(spark, sf_dir).select("event_id", pick(["oracle", "oracle_jitter_1", "heuristic"], e % 3).alias("source"), (e % 6).alias("rank"), pick(["w5", "w10", "w20"], e % 7 % 3).alias("win"))
    return c.select("event_id", manifests.training_mask(F.col("source"), F.col("rank"), 3).alias("train"), manifests.candidate_mask(F.col("source"), F.col("rank"), F.col("win"), 3, ["w5", "w20"]).alias("candidate"))


@query(" SELECT DISTINCT ON (k) doc_id, k FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'key-' || source WHEN lang IS NOT NULL AND lang <> '' AND source <> '' THEN lang || '|' || source ELSE 'row:' || doc_id END AS k FROM documents) ORDER BY k, doc_id")
def sequence_dedup(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    k = manifests.sequence_key(F.when(F.col("doc_id") % 3 == 0, F.col("sample_key")), F.col("lang"), F.col("source"), F.col("doc_id"))
    return manifests.first_rows(m.select("doc_id", k.alias("k")), ["k"], ["doc_id"])


@query(" SELECT doc_id AS id, 'document' AS kind, lang, NULL::DOUBLE AS label FROM documents UNION ALL SELECT vec_id, 'vector', NULL, label::DOUBLE FROM embeddings")
def union_filled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang")
    return manifests.union_filled(d, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vector").alias("kind"), F.col("label").cast("double").alias("label")))


@query(" SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY md5('42|' || doc_id), doc_id) <= 3")
def stratified_sample(spark, sf_dir):
    return manifests.sample_per_stratum(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", 3)


@query(" SELECT doc_id, lang AS language, source AS place, doc_id % 5 AS n FROM documents")
def note_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    notes = F.concat(F.lit(" Lang = none; lang="), F.coalesce("lang", F.lit("")), F.lit(";junk;place="), F.col("source"), F.lit("; n ="), (F.col("doc_id") % 5).cast("string"), F.lit(";=x"))
    m = d.select("doc_id", manifests.parse_notes(notes).alias("m"))
    return m.select("doc_id", F.nullif(F.col("m")["lang"], F.lit("")).alias("language"), F.col("m")["place"].alias("place"), F.col("m")["n"].cast("long").alias("n"))


@query(" SELECT s_suppkey::VARCHAR AS id, g AS \"group\" FROM (SELECT s_suppkey, min(s_suppkey::VARCHAR) OVER (PARTITION BY n_regionkey) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey)", "Z_ AS (SELECT 1)")
def positive_supergroups(spark, sf_dir):
    """Suppliers that share a nation, or nations' region through a chain of stand-in keys."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").join(n, "s_nationkey").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("region")).alias("even"), F.col("region").alias("both"))
    return manifests.supergroups(s, "s_suppkey", ["s_nationkey", "even", "both"])


def _channel_tokens(spark, sf_dir):
    """Part names and types as tokens of two channels; a family is a brand."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("sample"), F.lit("name").alias("channel"), F.explode(F.split("p_name", " ")).alias("token"))
    return names.unionByName(p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("sample"), F.lit("type").alias("channel"), F.concat("p_type", F.lit("-"), (F.col("p_size") % 9).cast("string")).alias("token"))).distinct()


_CT = """ct AS (SELECT DISTINCT * FROM (SELECT p_brand AS family, p_partkey AS sample, 'name' AS channel, unnest(string_split(p_name, ' ')) AS token FROM part UNION ALL SELECT p_brand, p_partkey, 'type', p_type || '-' || (p_size % 9) FROM part)), hf AS (SELECT DISTINCT family, channel, token FROM ct)"""


@query(""", sh AS (SELECT x.family AS a, y.family AS b, x.channel, count(*) AS n FROM hf x JOIN hf y ON x.channel = y.channel AND x.token = y.token AND x.family < y.family GROUP BY ALL), sz AS (SELECT family, count(*) FILTER (channel = 'name') AS name, count(*) FILTER (channel = 'type') AS type FROM hf GROUP BY 1),
pm AS (SELECT a, b, coalesce(sum(n) FILTER (channel = 'name'), 0)::BIGINT AS shared_name, coalesce(sum(n) FILTER (channel = 'type'), 0)::BIGINT AS shared_type FROM sh GROUP BY 1, 2),
m AS (SELECT a, b, shared_name, shared_type, CASE WHEN s.name + t.name - shared_name > 0 THEN shared_name / (s.name + t.name - shared_name) ELSE 0 END AS name, CASE WHEN s.type + t.type - shared_type > 0 THEN shared_type / (s.type + t.type - shared_type) ELSE 0 END AS type FROM pm JOIN sz s ON s.family = a JOIN sz t ON t.family = b)
SELECT a, b, shared_name, shared_type, round(name, 6) AS name, round(type, 6) AS type, CASE WHEN shared_type >= 40 THEN 'same_script' WHEN shared_name >= 60 THEN 'same_backend' WHEN type >= 0.2 THEN 'near_dom' WHEN name >= 0.5 THEN 'near_text' END AS reason FROM m""", _CT)
def pair_metrics_and_reason(spark, sf_dir):
    m = grouping.pair_metrics(_channel_tokens(spark, sf_dir), ["name", "type"])
    rules = (("same_script", "shared_type", 40), ("same_backend", "shared_name", 60), ("near_dom", "type", 0.2), ("near_text", "name", 0.5))
    return rounded(m.withColumn("reason", grouping.merge_reason({c: F.col(c) for c in m.columns}, rules)))


@query(", w AS (SELECT family, count(DISTINCT sample) AS samples FROM ct GROUP BY 1), k AS (SELECT family, channel, token FROM ct GROUP BY ALL HAVING count(*) >= 3), f AS (SELECT family, count(DISTINCT (channel, token)) AS keys, count(DISTINCT channel) AS channels, count(DISTINCT sample) AS c FROM ct JOIN k USING (family, channel, token) GROUP BY 1) SELECT family, samples, coalesce(keys, 0) AS keys, coalesce(channels, 0) AS channels, round(coalesce(c, 0) / samples, 6) AS covered FROM w LEFT JOIN f USING (family)", _CT)
def evidence_support(spark, sf_dir):
    return rounded(grouping.repeated_support(_channel_tokens(spark, sf_dir), 3))


@query(" SELECT source AS family, count(*) AS size, count(DISTINCT lang) AS n_lang, string_agg(DISTINCT lang, '|' ORDER BY lang) AS lang FROM documents GROUP BY 1")
def family_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("family"), "lang")
    return grouping.family_summary(d, "family", ["lang"]).withColumn("lang", F.nullif(F.col("lang"), F.lit("")))


@query(""", c AS (SELECT coalesce(lang, '') AS a, coalesce(source, '') AS b, count(*) AS n FROM documents GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS pairs, any_value(t) AS t FROM c JOIN ra USING (a) JOIN rb USING (b), t), h AS (SELECT sum(-na / t * ln(na / t)) AS ha, sum(na * (na - 1) / 2) AS pa FROM ra, t), g AS (SELECT sum(-nb / t * ln(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS pb FROM rb, t)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round((pairs - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM m, h, g""", "Z_ AS (SELECT 1)")
def labelling_agreement(spark, sf_dir):
    return rounded(grouping.agreement(table(spark, sf_dir, "documents"), "lang", "source"))


@query(", g AS (SELECT dim, label, count(*) AS n, sum(x) AS s FROM lf GROUP BY ALL), t AS (SELECT dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lf GROUP BY 1), e AS (SELECT dim, (sum(g.s * g.s / g.n) - any_value(t.s * t.s / t.n)) / any_value(t.q - t.s * t.s / t.n) AS eta2 FROM g JOIN t USING (dim) GROUP BY dim) SELECT dim::INT AS dim, row_number() OVER (ORDER BY eta2 DESC, dim) <= ceil(count(*) OVER () * 0.3) AS kept FROM e", "lf AS (SELECT vec_id AS id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def feature_screen(spark, sf_dir):
    from tidemark.operators import vectors

    long = vectors.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return grouping.keep_top_share(vectors.eta_squared(long), "eta2", 0.3, "dim").select("dim", "kept")


@query("""(SELECT vec_id AS id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT dim, list_transform(range(1, 16), lambda i: i) AS i, [""" + ", ".join(f"quantile_cont(x, {i / 16})" for i in range(1, 16)) + """] AS cuts FROM lf GROUP BY 1), b AS (SELECT dim, label, len(list_filter(cuts, lambda c: c < x)) AS bin FROM lf JOIN q USING (dim)),
c AS (SELECT dim, bin, label, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT dim, n, sum(n) OVER (PARTITION BY dim) AS t, sum(n) OVER (PARTITION BY dim, bin) AS nb, sum(n) OVER (PARTITION BY dim, label) AS ny FROM c) SELECT dim::INT AS dim, round(sum(n / t * ln(n * t / (nb::DOUBLE * ny))), 6) AS mi FROM p GROUP BY 1""", "lf AS ")
def mutual_information(spark, sf_dir):
    from tidemark.operators import vectors

    long = vectors.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return rounded(grouping.binned_information(long, "dim", "x", "label"))


@query(" SELECT grp, count(*) AS n, round(coalesce(count(*) FILTER (y = 0 AND score < 0.5) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS specificity, round(quantile_cont(capture_id % 11, 0.5), 6) AS candidates_median, round(quantile_cont(capture_id % 11, 0.9), 6) AS candidates_p90 FROM pr GROUP BY 1", PREDICTIONS)
def partition_metrics(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("n_candidates", F.col("capture_id") % 11)
    return rounded(grouping.partition_metrics(rows, 0.5, "grp"))


@query(", w AS (SELECT y, score AS a, (capture_id % 10) / 10.0::DOUBLE AS b, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS weight FROM pr), c AS (SELECT weight, count(*) FILTER (y = 1 AND weight * a + (1 - weight) * b >= 0.5) AS tp, count(*) FILTER (y = 0 AND weight * a + (1 - weight) * b >= 0.5) AS fp, count(*) FILTER (y = 1 AND weight * a + (1 - weight) * b < 0.5) AS fn FROM w GROUP BY 1) SELECT weight, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c", PREDICTIONS)
def blend_search(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("y", F.col("score").alias("a"), (F.col("capture_id") % 10 / F.lit(10.0)).alias("b"))
    return rounded(grouping.blend_search(rows, [0.0, 0.25, 0.5, 0.75, 1.0], 0.5))


@query(" SELECT capture_id, CASE WHEN score < 0.3 THEN 'rejected' WHEN (capture_id % 10) / 10.0 <= 0.4 THEN 'accepted' ELSE 'unsupported' END AS verdict, round(least(greatest((capture_id % 10) / 10.0::DOUBLE / greatest(1 - (capture_id % 10) / 10.0::DOUBLE, 1e-6), 0.1), 10.0), 6) AS shift_weight FROM pr", PREDICTIONS)
def dual_support_gate(spark, sf_dir):
    d = F.col("capture_id") % 10 / F.lit(10.0)
    return rounded(predictions(spark, sf_dir).select("capture_id", grouping.dual_support(d, F.lit(0.4), F.col("score"), 0.3).alias("verdict"), grouping.odds_weights(d).alias("shift_weight")))
